"""Figures of an import at a glance, baselines, and comparisons with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import Graph
from .browse import by_closure, closure
from .fixpoint import top_by


def summary(graph: Graph) -> DataFrame:
    """One row: counts, redundancy, share of runtime edges, and depth."""
    nodes = graph.nodes.agg(F.count("*").alias("nodes"), F.count_if("is_top_level").alias("top_level"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"), F.percentile("depth", F.lit(0.5)).alias("median_depth"))
    edges = graph.edges.agg(
        F.count("*").alias("edges"), F.round(F.coalesce(F.try_divide(F.count_if("is_redundant").cast("double"), F.count("*").cast("double")), F.lit(0.0)), 6).alias("redundancy"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("dependency_type") == "runtime").cast("double"), F.count("dependency_type").cast("double")), F.lit(0.0)), 6).alias("runtime_ratio"),
    )
    return nodes.crossJoin(edges)


def top_contributors(graph: Graph, limit: int = 10, top_level_only: bool = False) -> DataFrame:
    nodes = graph.nodes.where("is_top_level") if top_level_only else graph.nodes
    return nodes.orderBy(*by_closure()).limit(limit).select("id", "label", closure().alias("closure_size"))


def type_distribution(graph: Graph) -> DataFrame:
    """Nodes, their share by the hundred, and closure by type."""
    counts = graph.nodes.groupBy(F.coalesce("package_type", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.sum(closure()).alias("closure"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def health(found: DataFrame) -> DataFrame:
    """Judgements of a summary row: redundancy under 5 and 10 per cent, mean depth under 5 and 8."""
    grade = lambda c, good, warn: F.when(c < good, "good").when(c < warn, "warning").otherwise("critical")
    return found.select(F.col("redundancy"), grade(F.col("redundancy"), 0.05, 0.10).alias("redundancy_health"), F.col("avg_depth"), grade(F.coalesce("avg_depth", F.lit(0.0)), 5, 8).alias("depth_health"))


def baseline(graph: Graph, baseline_id: int, name: str, *, system: bool = False, tags: tuple[str, ...] = (), created_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """A snapshot row: counts, counts by type and edge type, depth and the largest contributors."""
    types = graph.nodes.groupBy(F.coalesce("package_type", F.lit("unknown")).alias("k")).agg(F.count("*").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("by_type"))
    edges = graph.edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("dependency_type") == "runtime").alias("runtime_edges"), F.count_if(F.col("dependency_type") == "build").alias("build_edges"))
    nodes = graph.nodes.agg(F.count("*").alias("node_count"), F.count_if("is_top_level").alias("top_level_count"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 6).alias("avg_depth"))
    best = top_contributors(graph, 10).withColumn("place", F.row_number().over(Window.orderBy(F.col("closure_size").desc(), "label", "id")))  # ten rows
    best = best.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label", "closure_size"))), lambda x: F.struct(x["label"].alias("label"), x["closure_size"].alias("closure_size"))).alias("top_contributors"))
    return nodes.crossJoin(edges).crossJoin(types).crossJoin(best).select(
        F.lit(baseline_id).cast("bigint").alias("baseline_id"), F.lit(name).alias("name"), F.lit(system).alias("is_system"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"), F.to_timestamp_ntz(F.lit(created_at)).alias("created_at"), "*"
    )


def listed(baselines: DataFrame, include_system: bool = True, tags: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """Baselines with any of the tags, newest first."""
    rows = baselines if include_system else baselines.where("not is_system")
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return rows.orderBy(F.col("created_at").desc(), "baseline_id").limit(limit).select("baseline_id", "name", "node_count")


def without_baseline(baselines: DataFrame, baseline_id: int) -> DataFrame:
    return baselines.where(F.col("baseline_id") != baseline_id)


def updated_baseline(baselines: DataFrame, baseline_id: int, updated_at: str, *, name: str | None = None, tags: tuple[str, ...] | None = None) -> DataFrame:
    """The baselines with the name or tags of one changed, and ``updated_at`` set where anything is."""
    hit = (F.col("baseline_id") == baseline_id) & F.lit(name is not None or tags is not None)
    found = baselines.withColumn("updated_at", F.when(hit, F.to_timestamp_ntz(F.lit(updated_at))).otherwise(F.col("created_at")))
    if name is not None:
        found = found.withColumn("name", F.when(hit, name).otherwise(F.col("name")))
    if tags is not None:
        found = found.withColumn("tags", F.when(hit, F.array(*map(F.lit, tags)).cast("array<string>")).otherwise(F.col("tags")))
    return found


def live_entries(entries: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Stored results ``(…, computed_at)`` that have not expired; those without a time have."""
    return entries.where(F.col("computed_at") >= F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def growth(percent: Column) -> Column:
    return F.when(percent < 5, "minimal").when(percent < 15, "moderate").when(percent < 30, "significant").otherwise("excessive")


def growth_text(difference: Column, percent: Column, name: Column) -> Column:
    text = F.format_string("%s %s packages than %s (%+.1f%%)", F.format_number(F.abs(difference), 0), F.when(difference > 0, "more").otherwise("fewer"), name, percent)
    return F.when(difference == 0, F.concat(F.lit("Same size as "), name)).otherwise(text)


def compared(now: DataFrame, base: DataFrame) -> DataFrame:
    """One row: what a snapshot has over a baseline, and how much that is."""
    left = now.select("node_count", "edge_count", "top_level_count")
    right = base.select(F.col("name").alias("base_name"), F.col("node_count").alias("b_nodes"), F.col("edge_count").alias("b_edges"), F.col("top_level_count").alias("b_top"))
    both = left.crossJoin(right)
    diff = F.col("node_count") - F.col("b_nodes")
    percent = F.when(F.col("b_nodes") > 0, 100.0 * diff / F.col("b_nodes")).otherwise(0.0)
    return both.select("base_name", diff.alias("node_difference"), (F.col("edge_count") - F.col("b_edges")).alias("edge_difference"), (F.col("top_level_count") - F.col("b_top")).alias("top_level_difference"), F.round(percent, 6).alias("percent"), growth(percent).alias("growth"), growth_text(diff, percent, F.col("base_name")).alias("summary"))


def compared_types(now: DataFrame, base: DataFrame) -> DataFrame:
    """Nodes by type of a snapshot less those of a baseline, over the types of either."""
    side = lambda df, n: df.select(F.explode("by_type").alias("kind", n))
    both = side(now, "n").join(side(base, "b"), "kind", "full_outer")
    return both.select("kind", (F.coalesce("n", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("difference"))


def for_dashboard(baselines: DataFrame) -> DataFrame:
    """The oldest system baseline, else the newest of all."""
    return baselines.withColumn("place", F.when(F.col("is_system"), F.unix_micros(F.col("created_at").cast("timestamp"))).otherwise(F.lit(2**62) - F.unix_micros(F.col("created_at").cast("timestamp")))).orderBy(F.col("is_system").desc(), "place", "baseline_id").limit(1).select("baseline_id", "name")


def previous_imports(imports: DataFrame) -> DataFrame:
    """Each import with the latest earlier one of its name."""
    return imports.select("id", F.lag("id").over(Window.partitionBy("name").orderBy("imported_at", "id")).alias("previous_id"))


def presets(imports: DataFrame, baselines: DataFrame, import_id: int) -> DataFrame:
    """What an import can be compared with: the previous import, then system baselines, then others."""
    previous = previous_imports(imports).where((F.col("id") == import_id) & F.col("previous_id").isNotNull()).select(F.lit(1).alias("place"), F.lit("previous").alias("kind"), F.col("previous_id").alias("ref"))
    rest = baselines.select(F.when(F.col("is_system"), 2).otherwise(3).alias("place"), F.when(F.col("is_system"), "system").otherwise("user").alias("kind"), F.col("baseline_id").alias("ref"))
    return previous.unionByName(rest).orderBy("place", "ref")


def imports_of(imports: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return imports.where(F.col("name") == name).orderBy(F.col("imported_at").desc(), "id").limit(limit).select("id", "name", "config_path")


def auto_name(imports: DataFrame, suffix: str) -> DataFrame:
    return imports.select("id", F.concat("name", F.lit(" - "), F.date_format("imported_at", "yyyy-MM-dd"), F.lit(f" ({suffix})")).alias("baseline_name"))


def cache_candidates(graph: Graph, common: str = "glibc|openssl|python|bash|systemd", quota: int = 20) -> DataFrame:
    """Nodes worth keeping at hand: half the quota by well-known names, the rest by closure."""
    known = graph.nodes.where(F.col("label").rlike(f"(?i){common}")).orderBy(*by_closure()).limit(quota // 2).select("id", "label", "closure_size", F.lit(1).alias("pass"))
    rest = graph.nodes.orderBy(*by_closure()).limit(quota).select("id", "label", "closure_size", F.lit(2).alias("pass"))
    once = top_by(known.unionByName(rest), ["id"], [F.col("pass")], 1).drop("rank")
    return once.orderBy("pass", *by_closure()).limit(quota).select("id", "label", "pass")
