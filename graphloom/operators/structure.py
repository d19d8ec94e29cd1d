"""Structure: duplicates, paths, loops and redundant edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import Graph
from .fixpoint import checkpointed, downward, reach, strong_components, top_by, upward

#: Dependencies that speak for a build-time variant.
BUILD_WORDS = ["cargo", "rustc", "gcc", "clang", "hook", "wrapper", "stdenv"]


def duplicates(graph: Graph, min_count: int = 2) -> DataFrame:
    """All nodes of labels with at least ``min_count`` distinct hashes."""
    often = graph.nodes.groupBy("label").agg(F.countDistinct("drv_hash").alias("variants")).where(F.col("variants") >= min_count)
    return graph.nodes.join(often, "label").select("label", "variants", "drv_hash", "id")


def shortest_path(graph: Graph, source: int, target: int, max_depth: int = 20) -> DataFrame:
    """``(path, length)``: one shortest dependency path, through the smallest ids; no row if there is none."""
    seeds = graph.nodes.where(F.col("id") == source).select(F.col("id").alias("seed"))
    down = downward(graph.deps).distinct()
    level = seeds.select(F.col("seed").alias("id"), F.array("seed").alias("path"))
    seen = level.select("id")
    for depth in range(1, max_depth + 1):
        level = checkpointed(
            level.join(down, level["id"] == down["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path")).join(seen, "id", "left_anti").withColumn("path", F.array_append("path", F.col("id")))
        )
        hit = level.where(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select(F.array_join(F.col("path").cast("array<string>"), "→").alias("path"), F.lit(depth).cast("bigint").alias("length"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("id"))
    return level.limit(0).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("length"))


def node_context(graph: Graph, node_id: int, k: int = 10) -> DataFrame:
    """The most frequent (label, type) among a node's dependencies and dependents, by direction."""
    down = graph.deps.where(F.col("dependent") == node_id).select(F.lit("dependency").alias("direction"), F.col("dependency").alias("id"))
    up = graph.deps.where(F.col("dependency") == node_id).select(F.lit("dependent").alias("direction"), F.col("dependent").alias("id"))
    counted = down.unionByName(up).join(graph.nodes.select("id", "label", "package_type"), "id").groupBy("direction", "label", "package_type").agg(F.count("*").alias("n"))
    return top_by(counted, ["direction"], [F.col("n").desc(), F.col("label"), F.col("package_type")], k)


def node_role(graph: Graph, node_id: int) -> DataFrame:
    """`build-time`, `runtime` or `unknown` by a node's dependencies; without any it is runtime."""
    kinds = graph.deps.where(F.col("dependent") == node_id).select(F.col("dependency").alias("id")).join(graph.nodes.select("id", "label", "package_type"), "id")
    build = F.coalesce(F.bool_or(F.coalesce(F.col("package_type") == "development", F.lit(False)) | F.col("label").rlike("cargo|rustc")), F.lit(False))
    plain = F.coalesce(F.bool_and(F.col("package_type").isNull() | F.col("package_type").isin("library", "application")), F.lit(True))
    return kinds.agg(F.when(build, "build-time").when(plain, "runtime").otherwise("unknown").alias("role"))


def compare_duplicates(graph: Graph, label: str) -> DataFrame:
    """For each variant of a label: its build and runtime dependencies, some users, and whether it is built with."""
    variants = graph.nodes.where(F.col("label") == label).select("id", "drv_hash")
    names = graph.nodes.select(F.col("id").alias("dependency"), F.col("label").alias("dep_label"))
    deps = variants.join(graph.deps, F.col("id") == F.col("dependent"), "left").join(names, "dependency", "left")
    build = F.lower("dep_label").rlike("|".join(BUILD_WORDS))
    counted = deps.groupBy("id", "drv_hash").agg(F.count_if(build).alias("build_deps"), F.count_if(~build).alias("runtime_deps"))
    users = variants.join(graph.deps, F.col("id") == F.col("dependency")).select("id", F.col("dependent")).join(graph.nodes.select(F.col("id").alias("dependent"), F.col("label").alias("user")), "dependent")
    shown = top_by(users.select("id", "user").distinct(), ["id"], [F.col("user")], 5).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("user")), ", ").alias("used_by"))
    return counted.join(shown, "id", "left").select("id", "drv_hash", "build_deps", "runtime_deps", F.coalesce("used_by", F.lit("")).alias("used_by"), (F.col("build_deps") > F.col("runtime_deps") / 2.0).alias("is_build_time"))


def root_causes(graph: Graph, label: str, hops: int = 5, limit: int = 10) -> DataFrame:
    """Applications and services within some hops above the variants of a label."""
    seeds = graph.nodes.where(F.col("label") == label).select(F.col("id").alias("seed"))
    found = reach(upward(graph.deps), seeds, hops).select("seed", "id").join(graph.nodes.select("id", F.col("label").alias("cause"), "package_type"), "id")
    kept = found.where(F.col("package_type").isin("application", "service") & ~F.col("cause").endswith("-unwrapped") & ~F.col("cause").endswith("-wrapped"))
    return top_by(kept.select("seed", "cause").distinct(), ["seed"], [F.col("cause")], limit).select(F.col("seed").alias("id"), "cause")


def variant_links(graph: Graph, label: str, k: int = 10) -> DataFrame:
    """Links from the variants of a label to what needs them directly, the most frequent of each variant."""
    variants = graph.nodes.where(F.col("label") == label).select("id", F.concat("label", F.lit(" ("), F.substring("drv_hash", 1, 8), F.lit(")")).alias("source"))
    users = graph.nodes.select(F.col("id").alias("dependent"), F.col("label").alias("target"))
    links = variants.join(graph.deps, F.col("id") == F.col("dependency")).join(users, "dependent").groupBy("id", "source", "target").agg(F.count("*").alias("links"))
    return top_by(links, ["id"], [F.col("links").desc(), F.col("target")], k).groupBy("source", "target").agg(F.sum("links").alias("value"))


def loops(graph: Graph) -> DataFrame:
    """``(scc_id, id)`` of components of more than one node."""
    return strong_components(graph.deps).select("scc_id", "id")


def loop_paths(graph: Graph) -> DataFrame:
    """For each loop, its size and a shortest cycle through its smallest node, with its length; of equal ones by smallest nodes from its end."""
    found = checkpointed(strong_components(graph.deps))
    own = found.select(F.col("id").alias("src"), F.col("scc_id").alias("a"))
    other = found.select(F.col("id").alias("dst"), F.col("scc_id").alias("b"))
    within = checkpointed(downward(graph.deps).join(own, "src").join(other, "dst").where("a = b").select("src", "dst"))
    heads = found.select(F.col("scc_id").alias("seed")).distinct()
    depths = checkpointed(reach(within, heads).select(F.col("seed").alias("scc_id"), "id", "depth"))
    # one node before each, one level nearer to the start; a path for each loop then walks back from the start to itself
    near = depths.select(F.col("scc_id"), F.col("id").alias("src"), F.col("depth").alias("nearer"))
    steps = within.join(near, "src").join(depths.withColumnRenamed("id", "dst"), ["scc_id", "dst"]).where("depth = nearer + 1")
    before = checkpointed(steps.groupBy("scc_id", F.col("dst").alias("head")).agg(F.min("src").alias("before")))
    paths = depths.where("scc_id = id").select("scc_id", F.col("depth").alias("cycle_length"), F.array("scc_id").alias("path"))
    longest = paths.agg(F.max("cycle_length")).first()[0] or 0
    for _ in range(longest - 1):
        walked = paths.withColumn("head", F.col("path")[0]).join(before, ["scc_id", "head"], "left")
        more = F.when(F.col("before").isNotNull() & (F.size("path") < F.col("cycle_length")), F.concat(F.array("before"), F.col("path"))).otherwise(F.col("path"))
        paths = checkpointed(walked.select("scc_id", "cycle_length", more.alias("path")))
    cycle = F.array_join(F.concat(F.array("scc_id"), F.col("path")).cast("array<string>"), "→")
    return found.groupBy("scc_id").agg(F.count("*").alias("size")).join(paths.select("scc_id", "cycle_length", cycle.alias("cycle")), "scc_id")


def redundant_edges(graph: Graph, max_check: int | None = None, max_edges: int = 5) -> DataFrame:
    """Edges with another simple path of 2 to ``max_edges`` edges around them: its length, and the path through the smallest ids.

    The first ``max_check`` edges by (dependent, dependency) are checked, all if it is None. Lengths are tried from 2 on, and
    only edges without a shorter bypass, whose ends have neighbours that can be inside one, go on: first whether some node in the middle is reached from the dependent and reaches
    the dependency, by tables of pairs that so many steps join, then, for the few edges that have one, the path itself. A
    shortest bypass that avoids both ends repeats no node, so one path for each edge and node reached is enough.
    """
    edges = checkpointed(graph.deps.select(F.col("dependent").alias("a"), F.col("dependency").alias("c")).where("a <> c").distinct())
    left = edges if max_check is None else checkpointed(edges.orderBy("a", "c").limit(max_check))
    # nodes inside a path have a dependent and a dependency; an edge's ends must have such a neighbour, which few edges of wide graphs do
    inner = checkpointed(edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("c").alias("id")), "id", "left_semi"))
    into = checkpointed(edges.join(inner.select(F.col("id").alias("c")), "c", "left_semi").select("a", "c"))
    out = checkpointed(edges.join(inner.select(F.col("id").alias("a")), "a", "left_semi").select("a", "c"))
    left = checkpointed(left.join(out.select("c").distinct(), "c", "left_semi").join(into.select("a").distinct(), "a", "left_semi").select("a", "c"))
    starts = left.select("a").distinct().join(inner.select(F.col("id").alias("a")), "a", "left_anti")
    edges = checkpointed(out.unionByName(into.join(starts, "a", "left_semi").select("a", "c")))
    joined = {1: edges.select(F.col("a").alias("x"), F.col("c").alias("y"))}  # (x, y): a walk of so many edges leads from x to y
    found = []
    for n in range(2, max_edges + 1):
        ahead, behind = n - n // 2, n // 2
        for k in (ahead, behind):
            if k not in joined:  # one step more, for what an edge's dependent needs
                step = joined[1].select(F.col("x").alias("z"), F.col("y").alias("end"))
                joined[k] = checkpointed(joined[k - 1].join(step, F.col("y") == F.col("z")).where("x <> end").select("x", F.col("end").alias("y")).distinct())
        middle = left.join(joined[ahead].select(F.col("x").alias("a"), F.col("y").alias("m")), "a").where("m <> c")
        asked = checkpointed(middle.join(joined[behind].select(F.col("x").alias("m"), F.col("y").alias("c")), ["m", "c"], "left_semi").select("a", "c").distinct())
        if asked.isEmpty():
            continue
        paths = asked.select("a", "c", F.col("a").alias("x"), F.array("a").alias("path"))
        for k in range(1, n):
            paths = paths.join(edges.select(F.col("a").alias("x"), F.col("c").alias("y")), "x").where((F.col("y") != F.col("c")) & ~F.array_contains("path", F.col("y")))
            if n - k in joined:
                paths = paths.join(joined[n - k].select(F.col("x").alias("y"), F.col("y").alias("c")), ["y", "c"], "left_semi")
            paths = checkpointed(paths.groupBy("a", "c", F.col("y").alias("x")).agg(F.min(F.array_append("path", F.col("y"))).alias("path")))
        best = checkpointed(paths.groupBy("a", "c").agg(F.min(F.array_append("path", F.col("c"))).alias("path")))
        found.append(best.withColumn("n", F.lit(n).cast("bigint")))
        left = checkpointed(left.join(best, ["a", "c"], "left_anti"))
    if not found:
        found = [left.select("a", "c", F.array("a").alias("path"), F.lit(0).cast("bigint").alias("n")).limit(0)]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select(F.col("a").alias("dependent"), F.col("c").alias("dependency"), F.col("n").alias("bypass_length"), F.array_join(F.col("path").cast("array<string>"), "→").alias("bypass"))


def marked_redundant(graph: Graph, max_check: int | None = None) -> DataFrame:
    """All edges with ``is_redundant``."""
    found = redundant_edges(graph, max_check).select(F.col("dependent").alias("target_id"), F.col("dependency").alias("source_id"), F.lit(True).alias("hit"))
    return graph.edges.drop("is_redundant").join(found, ["source_id", "target_id"], "left").select("source_id", "target_id", F.coalesce("hit", F.lit(False)).alias("is_redundant"))


def running_share(df: DataFrame, value: str) -> DataFrame:
    """Share of a value in the whole, by the hundred."""
    return df.withColumn("share", 100.0 * F.col(value) / F.sum(value).over(Window.partitionBy()))
