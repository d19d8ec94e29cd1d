"""Sinks for comparisons and attributions, and readers of what package managers print as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.importing import service_packages


def file_name(name: Column, stamp: Column, suffix: str, longest: int = 30) -> Column:
    """A name without characters that file systems mind, cut to length, with a time stamp."""
    return F.concat(F.substring(F.regexp_replace(name, r"[^\w-]", "_"), 1, longest), F.lit("-"), F.date_format(stamp, "yyyyMMdd-HHmmss"), F.lit(f".{suffix}"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One row per difference or group, with a header in each part."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; each line is an object of the report."""
    rows.write.mode("overwrite").json(path)


def markdown(found: DataFrame) -> DataFrame:
    """``(place, line)`` of a report on categorised differences: a heading per kind and category, then its labels."""
    kinds = F.create_map(*[F.lit(x) for x in ("only_left", "Only in the first", "only_right", "Only in the second", "different", "Different")])
    rows = found.where("diff_type <> 'same'").select(kinds[F.col("diff_type")].alias("kind"), "category", "label")
    heads = rows.groupBy("kind", "category").agg(F.count("*").alias("n")).select("kind", "category", F.lit("").alias("label"), F.format_string("## %s: %s (%d)", "kind", "category", "n").alias("line"))
    lines = rows.withColumn("line", F.concat(F.lit("- "), "label")).unionByName(heads)
    return lines.select(F.struct("kind", "category", "label").alias("place"), "line")


def write_markdown(found: DataFrame, path: str) -> None:
    """Lines in order, over as many sorted parts as Spark makes."""
    markdown(found).orderBy("place").select("line").write.mode("overwrite").text(path)


def system_packages(spark: SparkSession, path: str) -> DataFrame:
    """Distinct package names of JSON lines `{"name": ...}` in order."""
    return spark.read.schema("name string").json(path).where("name is not null").distinct().orderBy("name")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(drv_name, metadata)`` from JSON lines `{"drv_name": ..., "metadata": {...}}`; the metadata stay JSON."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.drv_name").alias("drv_name"), F.get_json_object("value", "$.metadata").alias("metadata")).where("drv_name is not null")


def backfill(nodes: DataFrame, metadata: DataFrame, limit: int | None = None) -> DataFrame:
    """``(id, metadata)`` for nodes without metadata, the shallowest first."""
    missing = nodes.where("metadata is null").drop("metadata")
    if limit is not None:
        missing = missing.orderBy(F.col("depth").asc_nulls_last(), "id").limit(limit)
    return missing.join(metadata, "drv_name", "left").select("id", "metadata")


def package_modules(sources: DataFrame) -> DataFrame:
    """``(package, modules)`` from ``(package, source)``, in order."""
    return sources.groupBy("package").agg(F.array_sort(F.collect_set("source")).alias("modules"))


def enabled_modules(spark: SparkSession, path: str) -> DataFrame:
    """``(name)`` of the programs or services that files list as JSON arrays, one array a line; lines of another form give none."""
    names = spark.read.text(path).select(F.explode(F.from_json("value", "array<string>")).alias("name"))
    return names.where("name is not null").distinct().orderBy("name")


def module_sources(programs: DataFrame, services: DataFrame) -> DataFrame:
    """``(place, package, source)`` for ``marked_top_level``: services' packages come before programs of the same name."""
    named = lambda kind, name: F.concat(F.lit(f"{kind}."), F.col(name), F.lit(".enable")).alias("source")
    of_services = service_packages(services.select(F.col("name").alias("service"))).select("package", named("services", "service"), F.lit(1).alias("turn"))
    both = of_services.unionByName(programs.select(F.col("name").alias("package"), named("programs", "name"), F.lit(2).alias("turn")))
    best = both.groupBy("package").agg(F.min_by("source", F.struct("turn", "source")).alias("source"))
    return best.select(F.col("package").alias("place"), "package", "source")
