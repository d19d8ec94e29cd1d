"""Reading DOT graphs and computing what an import stores: types, depths, closure sizes and top-level marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import SERVICE_PACKAGES, edge_type, module_type, package_type
from ..sources.graph import Graph
from .fixpoint import downward, reach, top_by
from .reachability import reached_counts

#: The grammar of node and edge lines.
_NODE = r'^"([^"]+)"\s*\[label\s*=\s*"([^"]+)".*?\]'
_EDGE = r'^"([^"]+)"\s*->\s*"([^"]+)"(?:\s*\[color\s*=\s*"([^"]+)"\])?'


def split_name(full: Column) -> tuple[Column, Column]:
    """Hash and name of a DOT id: split at the first hyphen if 32 characters stand before it, else the first 32 are the hash."""
    fits = full.rlike("^[^-]{32}-")
    return F.substring(full, 1, 32), F.when(fits, F.regexp_extract(full, "^[^-]{32}-(.*)$", 1)).otherwise(full)


def parse_dot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(drv_hash, drv_name, label)`` and edges ``(source_hash, target_hash, edge_color)`` of DOT lines (`value`, `line`).

    Of nodes with one hash the last line counts; of equal edges the first; edges whose ends are unknown are dropped.
    """
    is_edge, is_node = F.col("value").rlike(_EDGE), F.col("value").rlike(_NODE)
    node_hash, node_name = split_name(F.regexp_extract("value", _NODE, 1))
    nodes = lines.where(is_node & ~is_edge).select("line", node_hash.alias("drv_hash"), node_name.alias("drv_name"), F.regexp_replace(F.regexp_extract("value", _NODE, 2), r"\.drv$", "").alias("label"))
    nodes = nodes.groupBy("drv_hash").agg(F.max_by(F.struct("drv_name", "label"), "line").alias("n")).select("drv_hash", "n.drv_name", "n.label")
    source, _ = split_name(F.regexp_extract("value", _EDGE, 1))
    target, _ = split_name(F.regexp_extract("value", _EDGE, 2))
    edges = lines.where(is_edge).select("line", source.alias("source_hash"), target.alias("target_hash"), F.nullif(F.regexp_extract("value", _EDGE, 3), F.lit("")).alias("edge_color"))
    # dealt once by source: equal edges and their source's node meet there
    edges = edges.repartition("source_hash").groupBy("source_hash", "target_hash").agg(F.min_by(F.struct("edge_color"), "line").alias("e")).select("source_hash", "target_hash", "e.edge_color")
    known = nodes.select("drv_hash")
    edges = edges.join(known.withColumnRenamed("drv_hash", "source_hash"), "source_hash", "left_semi").join(known.withColumnRenamed("drv_hash", "target_hash"), "target_hash", "left_semi")
    return nodes, edges.select("source_hash", "target_hash", "edge_color")


def read_dot(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_dot`` of files; the line order within a file is that of its bytes."""
    return parse_dot(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def import_dot(spark, path: str, import_id: int, name: str = "") -> tuple[DataFrame, Graph]:
    """A record ``(id, name, node_count, edge_count)`` and the graph of a DOT file; the record counts edge lines, repeated and dangling ones too.

    Ids hash the import and the node's hash, so that tasks need not agree on numbers and a rerun gives the same ones; the
    types are those of the names, and nothing is marked top-level yet.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    nodes, edges = parse_dot(lines)
    number = lambda drv_hash: F.xxhash64(F.lit(import_id).cast("bigint"), drv_hash)
    this, no = F.lit(import_id).cast("bigint").alias("import_id"), F.lit(None)
    own = nodes.select(
        number(F.col("drv_hash")).alias("id"), this, "drv_hash", "drv_name", "label", package_type(F.col("drv_name")).alias("package_type"), F.lit(False).alias("is_top_level"),
        no.cast("string").alias("top_level_source"), no.cast("string").alias("module_type"),
    )
    names = nodes.select(F.col("drv_hash").alias("source_hash"), F.col("drv_name").alias("source_name"))
    links = edges.join(names, "source_hash").select(
        this, number(F.col("source_hash")).alias("source_id"), number(F.col("target_hash")).alias("target_id"), edge_type(F.col("source_name")).alias("dependency_type"), "edge_color", F.lit(False).alias("is_redundant")
    )
    count = lines.agg(F.count_if(F.col("value").rlike(_EDGE)).alias("edge_count")).crossJoin(own.agg(F.count("*").alias("node_count")))
    return count.select(this.alias("id"), F.lit(name).alias("name"), "node_count", "edge_count"), Graph(own, links)


def dot_lines(graph: Graph) -> DataFrame:
    """DOT lines of a graph, nodes before edges."""
    name = lambda h, n: F.concat(F.lit('"'), h, F.lit("-"), n, F.lit('"'))
    nodes = graph.nodes.select(F.concat(name(F.col("drv_hash"), F.col("drv_name")), F.lit(' [label = "'), F.col("drv_name"), F.lit('"];')).alias("value"), F.col("id").alias("line"))
    ends = graph.nodes.select("id", "drv_hash", "drv_name")
    s, t = ends.select([F.col(c).alias(f"s_{c}") for c in ends.columns]), ends.select([F.col(c).alias(f"t_{c}") for c in ends.columns])
    edges = graph.edges.join(s, F.col("source_id") == F.col("s_id")).join(t, F.col("target_id") == F.col("t_id"))
    edges = edges.select(F.concat(name(F.col("s_drv_hash"), F.col("s_drv_name")), F.lit(" -> "), name(F.col("t_drv_hash"), F.col("t_drv_name")), F.lit(' [color = "red"];')).alias("value"), (F.col("source_id") + F.lit(10**12)).alias("line"))
    return nodes.unionByName(edges)


def reclassified_edges(graph: Graph) -> DataFrame:
    """Edges with their type by the name of the dependency."""
    names = graph.nodes.select(F.col("id").alias("source_id"), "drv_name")
    return graph.edges.join(names, "source_id").select("import_id", "source_id", "target_id", edge_type(F.col("drv_name")).alias("dependency_type"))


def root_nodes(graph: Graph) -> DataFrame:
    """``(import_id, root, dependents)``: the node that most nodes need, the smallest id of equals."""
    return top_by(graph.edges.groupBy("import_id", F.col("source_id").alias("root")).agg(F.count("*").alias("dependents")), ["import_id"], [F.col("dependents").desc(), F.col("root")], 1).drop("rank")


def depths(graph: Graph) -> DataFrame:
    """``(id, depth)`` of what the root of an import reaches downwards; other nodes have no depth."""
    roots = root_nodes(graph).select(F.col("root").alias("seed"))
    found = reach(downward(graph.deps), roots).where("id <> seed").select("id", "depth")
    return found.unionByName(roots.select(F.col("seed").alias("id"), F.lit(0).cast("bigint").alias("depth")))


def closure_sizes(graph: Graph) -> DataFrame:
    """``(id, closure_size)`` of nodes with dependencies; leaves have none."""
    return reached_counts(graph.deps)


def with_stages(graph: Graph) -> Graph:
    """The graph with depths and closure sizes."""
    nodes = graph.nodes.drop("depth", "closure_size").join(depths(graph), "id", "left").join(closure_sizes(graph), "id", "left")
    return Graph(nodes, graph.edges)


def top_level_sources(system: list[str], programs: dict[str, str], services: dict[str, str], spark) -> DataFrame:
    """``(package, source)``; services come before programs before system packages where a package has more."""
    rows = [(p, "systemPackages", 1) for p in system] + [(p, s, 2) for p, s in programs.items()] + [(p, s, 3) for p, s in services.items()]
    df = spark.createDataFrame(rows, "package string, source string, place int")
    return df.groupBy("package").agg(F.max_by("source", "place").alias("source"))


def service_packages(services: DataFrame) -> DataFrame:
    """``(service, package)``: listed packages, else the service's own name; a service may have none."""
    table = F.create_map(*[x for k, v in SERVICE_PACKAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return services.select("service", F.explode(F.coalesce(F.try_element_at(table, F.col("service")), F.array("service"))).alias("package"))


def marked_top_level(graph: Graph, sources: DataFrame) -> DataFrame:
    """``(id, top_level_source, module_type)`` of nodes labelled as a package of ``sources(place, package, source)`` or that and a version.

    The first package by place counts. A label is cut at each hyphen, so the match is an equi-join.
    """
    words = F.split("label", "-")
    prefixes = graph.nodes.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), "-"))).alias("package"))
    hit = prefixes.join(sources, "package").groupBy("id").agg(F.min_by("source", "place").alias("top_level_source"))
    return hit.withColumn("module_type", module_type(F.col("top_level_source")))


def module_summary(graph: Graph) -> DataFrame:
    """One row per import: top-level packages by kind of module, and how many sources they have."""
    kind = F.coalesce("module_type", F.lit("other"))
    top = graph.nodes.where("is_top_level")
    return top.groupBy("import_id").agg(
        F.count_if(kind == "systemPackages").alias("system_packages"), F.count_if(kind == "programs").alias("programs"), F.count_if(kind == "services").alias("services"),
        F.count_if(kind == "other").alias("other"), F.countDistinct("top_level_source").alias("sources"),
    )


def module_top_sources(graph: Graph, k: int = 10, names: int = 5) -> DataFrame:
    """The sources of most closure, each with its largest packages."""
    top = graph.nodes.where("is_top_level and top_level_source is not null").withColumn("size", F.coalesce("closure_size", F.lit(0)))
    ranked = F.row_number().over(Window.partitionBy("top_level_source").orderBy(F.col("size").desc(), "label", "id"))
    top = top.withColumn("place", ranked)
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= names, F.struct("place", "label")))), lambda x: x["label"]), ", ")
    return top.groupBy("top_level_source").agg(F.count("*").alias("packages"), F.sum("size").alias("closure"), shown.alias("largest")).orderBy(F.col("closure").desc(), "top_level_source").limit(k)


def metadata_summary(metadata: DataFrame) -> DataFrame:
    """System, builder and sizes of derivation metadata in JSON (`id`, `metadata`)."""
    schema = "system string, builder string, outputs map<string,string>, inputDrvs map<string,string>, inputSrcs array<string>, env map<string,string>"
    m = F.from_json("metadata", schema)
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return metadata.select("id", m["system"].alias("system"), m["builder"].alias("builder"), F.array_join(F.array_sort(F.coalesce(F.map_keys(m["outputs"]), F.array().cast("array<string>"))), ",").alias("outputs"), size(m["inputDrvs"]).alias("input_drvs"), size(m["inputSrcs"]).alias("input_srcs"), size(m["env"]).alias("env_keys"))
