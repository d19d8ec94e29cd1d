"""Statements of DOT drawings, one per row: clusters, the surroundings of a node, and what a zoom level shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import truncated
from ..sources.graph import Graph
from .browse import by_closure
from .zoom import aggregates, cluster_edges, cluster_nodes, overview_edges, overview_nodes

#: Fill colours by package type; all other types have that of `other`.
COLOURS = {
    "kernel": "#ff6b6b", "firmware": "#ffa94d", "service": "#69db7c", "library": "#74c0fc", "development": "#b197fc", "bootstrap": "#f783ac", "configuration": "#ffd43b",
    "python-package": "#3b82f6", "perl-package": "#8b5cf6", "font": "#ec4899", "documentation": "#94a3b8", "application": "#22d3ee", "mixed": "#a1a1aa", "other": "#e2e8f0",
}


def colour(package_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(package_type, F.lit("other"))), F.lit(COLOURS["other"]))


def quoted(text: Column) -> Column:
    """A DOT string: backslashes and quotes are escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _width(edges: Column, each: int, most: int) -> Column:
    """1 and a tenth for each so many edges, rounded half up, within a bound."""
    tenths = F.least(F.lit(10) + F.floor((edges * 10 + each // 2) / each), F.lit(most * 10))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def _node(name: Column, label: Column, package_type: Column, more: str = "") -> Column:
    return F.concat(name, F.lit(" [label="), label, F.lit(', fillcolor="'), colour(package_type), F.lit(f'"{more}];'))


def _id(column: str) -> Column:
    return F.concat(F.lit("n"), F.col(column).cast("string"))


def _edge(source: Column, target: Column, more: Column | str = "") -> Column:
    return F.concat(source, F.lit(" -> "), target, F.lit(more) if isinstance(more, str) else more, F.lit(";"))


def cluster_drawing(graph: Graph) -> DataFrame:
    """``(part, statement)``: a node per package type with its size, and edges between types, the wider the more they stand for."""
    label = F.concat(F.lit('"'), "kind", F.format_string('\\n(%d packages)"', "node_count"))
    nodes = cluster_nodes(graph).select(F.lit("nodes").alias("part"), _node(quoted(F.col("kind")), label, F.col("kind")).alias("statement"))
    more = F.concat(F.lit(" [penwidth="), _width(F.col("edges"), 100, 5), F.format_string(', tooltip="%d edges"]', "edges"))
    edges = cluster_edges(graph).select(F.lit("edges").alias("part"), _edge(quoted(F.col("source_kind")), quoted(F.col("target_kind")), more).alias("statement"))
    return nodes.unionByName(edges)


def node_drawing(graph: Graph, node_id: int, side: int = 20) -> DataFrame:
    """``(part, statement)``: a node between its dependents and its dependencies, so many a side, those of most closure first."""
    names = graph.nodes.select("id", "label", "package_type", "closure_size")
    near = lambda end, other: graph.deps.where(F.col(other) == node_id).select(F.col(end).alias("id")).distinct().join(names, "id").orderBy(*by_closure()).limit(side)
    users, needs = near("dependent", "dependency"), near("dependency", "dependent")
    each = lambda part, df, most=30: df.select(F.lit(part).alias("part"), _node(_id("id"), quoted(truncated(F.col("label"), most)), F.col("package_type")).alias("statement"))
    own = names.where(F.col("id") == node_id).select(F.lit("node").alias("part"), _node(_id("id"), quoted(F.col("label")), F.col("package_type"), ", penwidth=3").alias("statement"))
    this = F.lit(f"n{node_id}")
    into = users.select(F.lit("edges").alias("part"), _edge(_id("id"), this).alias("statement"))
    out = needs.select(F.lit("edges").alias("part"), _edge(this, _id("id")).alias("statement"))
    return each("dependents", users).unionByName(own).unionByName(each("dependencies", needs)).unionByName(into).unionByName(out)


def overview_drawing(graph: Graph, max_nodes: int = 100) -> DataFrame:
    """``(part, statement)``: the largest nodes of each type, a part per type, and the edges among them."""
    shown = overview_nodes(graph, max_nodes)
    part = F.concat(F.lit("cluster_"), F.replace("kind", F.lit("-"), F.lit("_")))
    nodes = shown.select(part.alias("part"), _node(_id("id"), quoted(truncated(F.col("label"), 30)), F.col("kind")).alias("statement"))
    edges = overview_edges(graph, max_nodes).select(F.lit("edges").alias("part"), _edge(_id("source_id"), _id("target_id")).alias("statement"))
    return nodes.unionByName(edges)


def aggregate_drawing(graph: Graph, by: str = "prefix", threshold: int = 5) -> DataFrame:
    """``(part, statement)``: a hexagon per group of nodes with its size and its largest labels."""
    label = F.concat(quoted(F.concat("grp", F.lit("*"))).substr(F.lit(1), F.length(quoted(F.concat("grp", F.lit("*")))) - 1), F.format_string('\\n(%d packages)"', "node_count"))
    more = F.concat(F.lit(" [label="), label, F.lit(', shape=hexagon, fillcolor="'), colour(F.col("package_type")), F.lit('", tooltip='), quoted(F.col("largest")), F.lit("];"))
    return aggregates(graph, by, threshold).select(F.lit("aggregates").alias("part"), F.concat(quoted(F.concat(F.lit("group:"), "grp")), more).alias("statement"))
