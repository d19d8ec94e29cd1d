"""Semantic zoom: clusters, an overview, details, and aggregates by prefix or depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_prefix
from ..sources.graph import Graph
from .browse import around, by_closure, closure, induced_edges
from .fixpoint import top_by


def level_of_scale(scale: float) -> str:
    return "cluster" if scale < 0.3 else "overview" if scale < 0.7 else "detailed"


def cluster_nodes(graph: Graph, shown: int = 3) -> DataFrame:
    """Types with their counts, closure and largest representatives."""
    nodes = graph.nodes.withColumn("kind", F.coalesce("package_type", F.lit("unknown")))
    best = top_by(nodes, ["kind"], by_closure(), shown).groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("representatives"))
    return nodes.groupBy("kind").agg(F.count("*").alias("node_count"), F.sum(closure()).alias("total_closure")).join(best, "kind")


def cluster_edges(graph: Graph) -> DataFrame:
    """How many edges lead from one type to another."""
    kind = lambda s: graph.nodes.select(F.col("id").alias(f"{s}_id"), F.coalesce("package_type", F.lit("unknown")).alias(s))
    joined = graph.edges.join(kind("source_kind"), F.col("source_id") == F.col("source_kind_id")).join(kind("target_kind"), F.col("target_id") == F.col("target_kind_id"))
    return joined.where("source_kind <> target_kind").groupBy("source_kind", "target_kind").agg(F.count("*").alias("edges"))


def overview_nodes(graph: Graph, max_nodes: int = 100) -> DataFrame:
    """The largest nodes of each type, five at least."""
    kinds = graph.nodes.select(F.coalesce("package_type", F.lit("unknown")).alias("kind")).agg(F.countDistinct("kind").alias("kinds"))
    ranked = top_by(graph.nodes.withColumn("kind", F.coalesce("package_type", F.lit("unknown"))), ["kind"], by_closure(), max_nodes)
    return ranked.crossJoin(kinds).where(F.col("rank") <= F.greatest(F.floor(F.lit(max_nodes) / F.greatest(F.col("kinds"), F.lit(1))), F.lit(5))).select("kind", "rank", "id", "label")


def overview_edges(graph: Graph, max_nodes: int = 100) -> DataFrame:
    return induced_edges(graph, overview_nodes(graph, max_nodes))


def detailed_nodes(graph: Graph, centre: int, hops: int = 2, limit: int | None = None) -> DataFrame:
    found = around(graph, centre, hops).withColumnRenamed("depth", "hops").join(graph.nodes.select("id", "label"), "id")
    return found if limit is None else found.orderBy("hops", "label", "id").limit(limit)


def _group_of(graph: Graph, by: str) -> DataFrame:
    group = label_prefix(F.col("label")) if by == "prefix" else F.concat(F.lit("depth-"), (F.floor(F.coalesce("depth", F.lit(0)) / 2) * 2).cast("string"))
    return graph.nodes.withColumn("grp", group)


def aggregates(graph: Graph, by: str = "prefix", threshold: int = 5) -> DataFrame:
    """Groups of at least ``threshold`` nodes: type or `mixed`, closure, mean depth, largest labels."""
    nodes = _group_of(graph, by)
    best = top_by(nodes, ["grp"], by_closure(), 3).groupBy("grp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("largest"))
    kinds = F.coalesce("package_type", F.lit("unknown"))
    found = nodes.groupBy("grp").agg(F.count("*").alias("node_count"), F.when(F.countDistinct(kinds) == 1, F.min(kinds)).otherwise("mixed").alias("package_type"), F.sum(closure()).alias("total_closure"), F.round(F.avg(F.coalesce("depth", F.lit(0))), 6).alias("avg_depth"))
    return found.where(F.col("node_count") >= threshold).join(best, "grp")


def aggregate_edges(graph: Graph, by: str = "prefix", threshold: int = 5) -> DataFrame:
    """Edges between groups and single nodes, counted; those within a group are left out."""
    nodes = _group_of(graph, by)
    large = nodes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select("grp", F.lit(True).alias("large"))
    place = nodes.join(large, "grp", "left").select("id", F.when(F.col("large"), F.concat(F.lit("group:"), F.col("grp"))).otherwise(F.concat(F.lit("node:"), F.col("id").cast("string"))).alias("place"))
    source, target = place.select(F.col("id").alias("source_id"), F.col("place").alias("source")), place.select(F.col("id").alias("target_id"), F.col("place").alias("target"))
    return graph.edges.join(source, "source_id").join(target, "target_id").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("edges"))


def expanded(graph: Graph, group: str, by: str = "prefix") -> DataFrame:
    """The nodes of a group."""
    return _group_of(graph, by).where(F.col("grp") == group).select("id", "label")


def semantic_graph(graph: Graph, scale: float, centre: int | None = None, max_nodes: int = 100) -> DataFrame:
    """``(part, source, target, count)`` of the level that a scale shows: clusters, an overview, or the surroundings of a node.

    A row of `node` has no target; it counts the members of a cluster, 1 otherwise. Without a centre details are the overview's.
    """
    level = level_of_scale(scale)
    part = lambda name, source, target, n: [F.lit(name).alias("part"), source.cast("string").alias("source"), target.cast("string").alias("target"), n.cast("bigint").alias("count")]
    none, one = F.lit(None), F.lit(1)
    if level == "cluster":
        nodes = cluster_nodes(graph).select(part("node", F.col("kind"), none, F.col("node_count")))
        return nodes.unionByName(cluster_edges(graph).select(part("edge", F.col("source_kind"), F.col("target_kind"), F.col("edges"))))
    if level == "overview" or centre is None:
        shown = overview_nodes(graph, max_nodes).select("id")
    else:
        shown = detailed_nodes(graph, centre, 2, max_nodes).select("id")
    ends = lambda c: shown.select(F.col("id").alias(c))
    edges = graph.edges.join(ends("source_id"), "source_id", "left_semi").join(ends("target_id"), "target_id", "left_semi")
    return shown.select(part("node", F.col("id"), none, one)).unionByName(edges.select(part("edge", F.col("source_id"), F.col("target_id"), one)))


def zoom_info(graph: Graph, threshold: int = 5) -> DataFrame:
    """``(level, shown)``: how many clusters, overview nodes, nodes and groups by prefix an import has."""
    count = lambda level, df: df.agg(F.count("*").alias("shown")).select(F.lit(level).alias("level"), "shown")
    levels = [count("cluster", cluster_nodes(graph)), count("overview", overview_nodes(graph)), count("detailed", graph.nodes), count("aggregate", aggregates(graph, "prefix", threshold))]
    return reduce(DataFrame.unionByName, levels)
