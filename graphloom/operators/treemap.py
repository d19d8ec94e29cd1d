"""Hierarchical roll-ups for treemaps, as flat rows: (grp, rank, label, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from .browse import by_closure, closure
from .fixpoint import top_by


def _value():
    return F.greatest(closure(), F.lit(1))


def _with_others(ranked: DataFrame, everything: DataFrame, groups: list[str]) -> DataFrame:
    """Ranked rows and, per group, one row for all others."""
    total = everything.groupBy(*groups).agg(F.count("*").alias("n"), F.sum("value").alias("sum"))
    shown = ranked.groupBy(*groups).agg(F.count("*").alias("n_shown"), F.sum("value").alias("sum_shown"), F.max("rank").alias("last"))
    rest = total.join(shown, groups).where("n > n_shown").select(*groups, (F.col("last") + 1).alias("rank"), F.format_string("%d others", F.col("n") - F.col("n_shown")).alias("label"), (F.col("sum") - F.col("sum_shown")).alias("value"))
    return ranked.select(*groups, "rank", "label", "value").unionByName(rest)


def by_type(graph: Graph, limit: int = 20) -> DataFrame:
    nodes = graph.nodes.withColumn("grp", F.coalesce("package_type", F.lit("unknown"))).withColumn("value", _value())
    return _with_others(top_by(nodes, ["grp"], by_closure(), limit), nodes, ["grp"])


def by_depth(graph: Graph, levels: int = 3, limit: int = 20) -> DataFrame:
    """The first levels of depth; nodes without a depth stand at 0."""
    nodes = graph.nodes.withColumn("grp", F.coalesce("depth", F.lit(0)).cast("string")).withColumn("value", _value()).where(F.coalesce("depth", F.lit(0)) < levels)
    return _with_others(top_by(nodes, ["grp"], by_closure(), limit), nodes, ["grp"])


def flat(graph: Graph, limit: int = 20) -> DataFrame:
    nodes = graph.nodes.withColumn("grp", F.lit("all")).withColumn("value", _value())
    ranked = nodes.orderBy(*by_closure()).limit(limit)
    return _with_others(top_by(ranked, ["grp"], by_closure(), limit), nodes, ["grp"])


def filtered(graph: Graph, filter_type: str = "all") -> tuple[DataFrame, DataFrame]:
    """Dependencies and nodes that a filter shows: `all`, `runtime` or `build` dependencies, or `type:` and a package type."""
    deps, nodes = graph.deps, graph.nodes
    if filter_type in ("runtime", "build"):
        return deps.where(F.col("dep_type") == filter_type), nodes
    if filter_type.startswith("type:"):
        return deps, nodes.where(F.col("package_type") == filter_type.removeprefix("type:"))
    return deps, nodes


def children(graph: Graph, roots: DataFrame, levels: int = 2, limit: int = 20, filter_type: str = "all") -> DataFrame:
    """Dependencies below ``roots(id)`` level by level, the largest of each parent; each level shows half as many."""
    deps, nodes = filtered(graph, filter_type)
    names = nodes.select(F.col("id").alias("dependency"), "label", "closure_size")
    level, out = roots.select(F.col("id").alias("parent")).distinct(), None
    for depth in range(1, levels + 1):
        below = level.join(deps.select("dependent", "dependency"), F.col("parent") == F.col("dependent")).join(names, "dependency").select("parent", F.col("dependency").alias("id"), "label", "closure_size")
        now = top_by(below, ["parent"], by_closure(), limit).select(F.lit(depth).cast("bigint").alias("level"), "parent", "rank", "id", "label", _value().alias("value"))
        out = now if out is None else out.unionByName(now)
        level, limit = now.select(F.col("id").alias("parent")).distinct(), max(1, limit // 2)
    return out


def by_application(graph: Graph, limit: int = 20, levels: int = 2, filter_type: str = "all") -> DataFrame:
    """Top-level packages of most closure with their dependencies below."""
    top = filtered(graph, filter_type)[1].where("is_top_level").orderBy(*by_closure()).limit(limit)
    head = top_by(top.withColumn("parent", F.lit(0).cast("bigint")), ["parent"], by_closure(), limit).select(F.lit(0).cast("bigint").alias("level"), "parent", "rank", "id", "label", _value().alias("value"))
    return head.unionByName(children(graph, top.select("id"), levels, limit, filter_type))


def application_remainder(graph: Graph, limit: int = 20) -> DataFrame:
    """How many top-level packages a treemap by application leaves out, and their closure."""
    top = graph.nodes.where("is_top_level")
    shown = top.orderBy(*by_closure()).limit(limit).select("id")
    return top.join(shown, "id", "left_anti").agg(F.count("*").alias("others"), F.coalesce(F.sum(closure()), F.lit(0)).alias("closure"))


def from_node(graph: Graph, node_id: int, levels: int = 2, limit: int = 20, filter_type: str = "all") -> DataFrame:
    return children(graph, graph.nodes.where(F.col("id") == node_id).select("id"), levels, limit, filter_type)


def rooted(graph: Graph, node_id: int, levels: int = 2, limit: int = 20, filter_type: str = "all") -> DataFrame:
    """``from_node`` below the node's own row at level 0, which reads `Not Found` with value 0 where there is no such node."""
    own = graph.nodes.where(F.col("id") == node_id).agg(F.max("id").alias("id"), F.max("label").alias("label"), F.max(_value()).alias("value"))
    no, one = F.lit(0).cast("bigint"), F.lit(1).cast("int")
    head = own.select(no.alias("level"), no.alias("parent"), one.alias("rank"), "id", F.coalesce("label", F.lit("Not Found")).alias("label"), F.coalesce("value", F.lit(0)).alias("value"))
    return head.unionByName(from_node(graph, node_id, levels, limit, filter_type))


def treemap(graph: Graph, mode: str = "application", filter_type: str = "all", root: int | None = None, levels: int = 3, limit: int = 20) -> DataFrame:
    """The roll-up that ``mode`` names: `application`, `type`, `depth` or `flat`; with a ``root`` the one below that node.

    A filter by package type holds for all modes, one by kind of dependency where dependencies are followed.
    """
    if root is not None:
        return rooted(graph, root, levels, limit, filter_type)
    if mode == "application":
        return by_application(graph, limit, levels, filter_type)
    shown = Graph(filtered(graph, filter_type)[1], graph.edges)
    return by_type(shown, limit) if mode == "type" else by_depth(shown, levels, limit) if mode == "depth" else flat(shown, limit)


def node_info(graph: Graph, node_id: int) -> DataFrame:
    """A node with its numbers of dependencies and dependents."""
    own = graph.nodes.where(F.col("id") == node_id).select("id", "label", "package_type", "closure_size")
    down = graph.deps.where(F.col("dependent") == node_id).agg(F.count("*").alias("dependencies"))
    up = graph.deps.where(F.col("dependency") == node_id).agg(F.count("*").alias("dependents"))
    return own.crossJoin(down).crossJoin(up)


def package_types(graph: Graph) -> DataFrame:
    return graph.nodes.where("package_type is not null").groupBy("package_type").agg(F.count("*").alias("n"))
