"""Browsing a graph: lists, neighbours, subgraphs, search and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import similarity
from ..sources.graph import Graph
from ..sources.label_index import gram_rows
from .fixpoint import checkpointed, downward, reach, small, top_by
from .reachability import reached_counts
from .usage import below


def closure():
    return F.coalesce(F.col("closure_size"), F.lit(0))


def by_closure():
    return [closure().desc(), F.col("label"), F.col("id")]


def clusters(graph: Graph) -> DataFrame:
    """Nodes and total closure by package type, the largest first."""
    return graph.nodes.groupBy("package_type").agg(F.count("*").alias("node_count"), F.sum(closure()).alias("total_closure")).orderBy(F.col("node_count").desc(), "package_type")


def nodes_by_type(graph: Graph, package_type: str, limit: int = 100) -> DataFrame:
    return graph.nodes.where(F.col("package_type") == package_type).orderBy(*by_closure()).limit(limit).select("id", "label", "closure_size")


def node(graph: Graph, node_id: int) -> DataFrame:
    return graph.nodes.where(F.col("id") == node_id)


def node_with_closure(graph: Graph, node_id: int) -> DataFrame:
    """A node with its closure size, counted over what lies below it alone; null for a leaf."""
    found = node(graph, node_id)
    return found.drop("closure_size").join(reached_counts(below(graph.deps.select("dependent", "dependency"), found)).where(F.col("id") == node_id), "id", "left")


def node_by_hash(graph: Graph, drv_hash: str) -> DataFrame:
    return graph.nodes.where(F.col("drv_hash") == drv_hash)


def neighbours(graph: Graph, node_id: int) -> DataFrame:
    """Direct dependencies and dependents of a node, tagged by direction."""
    down = graph.deps.where(F.col("dependent") == node_id).select(F.lit("dependency").alias("direction"), F.col("dependency").alias("id"), "dep_type")
    up = graph.deps.where(F.col("dependency") == node_id).select(F.lit("dependent").alias("direction"), F.col("dependent").alias("id"), "dep_type")
    return down.unionByName(up).join(graph.nodes.select("id", "label"), "id").select("direction", "id", "label", "dep_type")


def induced_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    return graph.edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "dependency_type")


def subgraph(graph: Graph, *, ids: DataFrame | None = None, package_type: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The nodes of most closure, of a type if one is given, and the edges among them."""
    if ids is not None:
        nodes = graph.nodes.join(ids.select("id").distinct(), "id", "left_semi")
        return nodes, induced_edges(graph, nodes)
    nodes = graph.nodes if package_type is None else graph.nodes.where(F.col("package_type") == package_type)
    nodes = nodes.orderBy(*by_closure()).limit(limit)
    return nodes, induced_edges(graph, nodes)


def search(graph: Graph, text: str, limit: int = 20, least: float = 0.3) -> DataFrame:
    """Labels by trigram similarity to a text."""
    return graph.nodes.withColumn("sim", similarity(F.col("label"), F.lit(text))).where(F.col("sim") >= least).orderBy(F.col("sim").desc(), "label", "id").limit(limit).select("id", "label", F.round("sim", 6).alias("sim"))


def top_level_nodes(graph: Graph, source: str | None = None, limit: int = 50) -> DataFrame:
    top = graph.nodes.where("is_top_level")
    if source is not None:
        top = top.where(F.col("top_level_source") == source)
    return top.orderBy(*by_closure()).limit(limit).select("id", "label", "top_level_source", "closure_size")


def top_level_sources(graph: Graph) -> DataFrame:
    return graph.nodes.where("is_top_level").groupBy("top_level_source").agg(F.count("*").alias("packages"))


def graph_roots(graph: Graph, limit: int = 50) -> DataFrame:
    """Nodes that nothing needs."""
    return graph.nodes.join(graph.edges.select(F.col("source_id").alias("id")), "id", "left_anti").orderBy(*by_closure()).limit(limit).select("id", "label", "closure_size")


def impact(graph: Graph, node_id: int, max_depth: int = 20) -> DataFrame:
    """Transitive dependencies of a node by type: how many, how many direct, and the least and greatest depth."""
    seeds = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    found = reach(downward(graph.deps), seeds, max_depth).select("id", F.col("depth").alias("hops"))
    return found.join(graph.nodes.select("id", "package_type"), "id").groupBy("package_type").agg(
        F.count("*").alias("packages"), F.count_if(F.col("hops") == 1).alias("direct"), F.min("hops").alias("nearest"), F.max("hops").alias("farthest")
    )


def around(graph: Graph, node_id: int, depth: int = 2) -> DataFrame:
    """``(id, depth)``: what lies within some undirected hops of a node, the node itself at 0."""
    both = graph.edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    found = reach(both, seeds, depth).where("id <> seed").select("id", "depth")
    return found.unionByName(seeds.select(F.col("seed").alias("id"), F.lit(0).cast("bigint").alias("depth")))


def defined_packages(graph: Graph, names: DataFrame, hits: int = 5, least: float = 0.3) -> DataFrame:
    """For each of ``names(name)`` the node that it stands for, or none.

    Of the labels most similar to the name's first word, the first that equals the name, or begins with it and a
    hyphen, or that the name begins with so, is taken.
    """
    wanted = names.select("name", F.substring_index("name", "-", 1).alias("label")).distinct()
    # a shared trigram is needed for any similarity, so candidates meet by trigram and those that they share are counted; the names
    # go to the nodes, and candidates, which may be most nodes, carry their labels and are in no other join
    left = small(checkpointed(gram_rows(wanted).select("name", "gram", F.col("size").alias("of_word"))))
    right = gram_rows(graph.nodes.select("id", "label", F.col("label").alias("text"), F.monotonically_increasing_id().alias("row")))
    shared = right.join(left, "gram").groupBy("name", "of_word", "row", "id", "text", "size").agg(F.count("*").alias("shared"))
    pairs = shared.withColumn("sim", F.col("shared").cast("double") / (F.col("of_word") + F.col("size") - F.col("shared"))).where(F.col("sim") >= least)
    near = top_by(pairs.withColumnRenamed("text", "label"), ["name"], [F.col("sim").desc(), F.col("label"), F.col("id").asc_nulls_last()], hits)
    fits = (F.col("label") == F.col("name")) | F.startswith("label", F.concat("name", F.lit("-"))) | F.startswith("name", F.concat("label", F.lit("-")))
    first = near.where(fits).groupBy("name").agg(F.min_by(F.struct("id", "label"), "rank").alias("n"))
    return wanted.select("name").join(first, "name", "left").select("name", F.col("n.id").alias("id"), F.col("n.label").alias("label"))


def module_packages(graph: Graph, system_label: str, defined: DataFrame) -> DataFrame:
    """Direct dependencies of the system node whose label and base name are not ``defined(name)``."""
    system = graph.nodes.where(F.col("label") == system_label).select(F.col("id").alias("dependent"))
    direct = graph.deps.join(system, "dependent", "left_semi").select(F.col("dependency").alias("id")).distinct().join(graph.nodes, "id").withColumn("base", F.substring_index("label", "-", 1))
    kept = direct.join(defined.select(F.col("name").alias("label")), "label", "left_anti").join(defined.select(F.col("name").alias("base")), "base", "left_anti")
    return kept.select("id", "label", "base")
