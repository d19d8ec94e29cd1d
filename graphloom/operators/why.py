"""Why a package is there: paths from top-level packages, their groups, and what its removal would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import module_type
from ..sources.graph import Graph
from .fixpoint import downward, reach, simple_paths, top_by, upward
from .usage import walk


def reverse_edges(graph: Graph, include_build: bool = True) -> DataFrame:
    """Edges from a dependency to what needs it; without build edges only runtime and untyped ones."""
    edges = graph.edges if include_build else graph.edges.where("dependency_type = 'runtime' or dependency_type is null")
    return edges.select(F.col("source_id").alias("dependency"), F.col("target_id").alias("dependent"), F.coalesce("dependency_type", F.lit("unknown")).alias("dep_type"))


def direct_dependents(graph: Graph, node_id: int) -> DataFrame:
    found = graph.deps.where(F.col("dependency") == node_id).select(F.col("dependent").alias("id"), "dep_type")
    return found.join(graph.nodes.select("id", "label"), "id").select("id", "label", "dep_type")


def attribution_paths(graph: Graph, node_id: int, max_depth: int = 10, max_paths: int | None = 100, include_build: bool = True) -> DataFrame:
    """``(top_id, path, length, is_runtime)``: simple paths from a top-level package to a node.

    A branch ends at the first top-level package that it meets. The shortest paths stay, then the first by ids; with
    ``max_paths`` None all do. A node that is top-level has one path, of length 0.
    """
    seeds = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    own = graph.nodes.where((F.col("id") == node_id) & F.col("is_top_level")).select(F.col("id").alias("top_id"), F.array("id").alias("path"), F.array().cast("array<string>").alias("kinds"))
    edges = reverse_edges(graph, include_build)
    steps = edges.select(F.col("dependency").alias("src"), F.col("dependent").alias("dst"), F.col("dep_type").alias("kind"))
    stops = graph.nodes.where("is_top_level").select(F.col("id").alias("stop"))
    if own.isEmpty():
        found = simple_paths(steps, seeds, max_depth, stops).select(F.element_at("path", -1).alias("top_id"), F.reverse("path").alias("path"), F.reverse("kinds").alias("kinds"))
    else:
        found = own
    found = found.select("top_id", "path", (F.size("path") - 1).cast("bigint").alias("length"), F.forall("kinds", lambda k: k.isin("runtime", "unknown")).alias("is_runtime"))
    return found if max_paths is None else found.orderBy("length", "path").limit(max_paths)


def written(paths: DataFrame) -> DataFrame:
    return paths.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "→"))


def essentiality(paths: DataFrame) -> DataFrame:
    """One row: status, runtime and build-only dependents, lengths, and whether a top-level package needs it directly."""
    by_top = paths.groupBy("top_id").agg(F.bool_or("is_runtime").alias("runtime"), F.sum(F.when(F.col("is_runtime"), F.col("length"))).alias("runtime_length"), F.count_if("is_runtime").alias("runtime_paths"), F.sum("length").alias("length"), F.count("*").alias("n"), F.max("length").alias("longest"), F.bool_or(F.col("length") == 1).alias("direct"))
    one = by_top.agg(
        F.count("*").alias("tops"), F.count_if("runtime").alias("runtime_dependents"), F.count_if(~F.col("runtime")).alias("build_dependents"), F.coalesce(F.sum("n"), F.lit(0)).alias("paths"),
        F.coalesce(F.try_divide(F.sum("length"), F.sum("n")), F.lit(0.0)).alias("avg_length"), F.coalesce(F.max("longest"), F.lit(0)).alias("max_length"), F.coalesce(F.bool_or("direct"), F.lit(False)).alias("is_direct"),
        F.coalesce(F.try_divide(F.sum("runtime_length"), F.sum("runtime_paths")), F.lit(0.0)).alias("avg_runtime_length"),
    )
    status = (
        F.when(F.col("paths") == 0, "orphan").when(F.col("runtime_dependents") == 0, "build_only").when(F.col("avg_runtime_length") > 5, "essential_deep")
        .when(F.col("runtime_dependents") == 1, "essential_single").otherwise("essential")
    )
    depth = F.when(F.col("is_direct"), "direct").when(F.col("avg_length") <= 2, "shallow").when(F.col("avg_length") <= 5, "moderate").otherwise("deep")
    return one.select(status.alias("status"), "runtime_dependents", "build_dependents", "paths", F.round("avg_length", 6).alias("avg_length"), "max_length", "is_direct", depth.alias("depth_category"))


def unique_dependencies(graph: Graph, node_id: int, limit: int | None = 50, max_depth: int | None = 20) -> DataFrame:
    """Dependencies of a node that no top-level package reaches, but for those that need the node directly; the first by label, or all with ``limit`` None.

    A top-level node is among the packages that reach them, so it has none.
    """
    seeds = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    own = reach(downward(graph.deps), seeds, max_depth).select("id")
    direct = graph.deps.where(F.col("dependency") == node_id).select(F.col("dependent").alias("id"))
    others = graph.nodes.where("is_top_level").join(direct, "id", "left_anti").select(F.col("id").alias("seed"))
    # one walk from all other packages at once: which of them reaches a node does not matter
    seen = walk(downward(graph.deps), others.select(F.col("seed").alias("start")))
    found = own.join(seen, "id", "left_anti").join(graph.nodes.select("id", "label"), "id")
    return found if limit is None else found.orderBy("label", "id").limit(limit)


def removal_impact(graph: Graph, node_id: int, paths: DataFrame) -> DataFrame:
    """How many packages would break, by how much the closure would shrink, and whether removal is safe. All that would go counts, at any depth."""
    state = essentiality(paths)
    shrink = unique_dependencies(graph, node_id, None, None).agg((F.count("*") + 1).alias("closure_reduction"))
    # the package that alone is affected is named
    tops = paths.where("is_runtime").select(F.col("top_id").alias("id")).distinct().join(graph.nodes.select("id", "label"), "id")
    one = state.crossJoin(shrink).crossJoin(tops.agg(F.min("label").alias("only")))
    safe = F.col("status").isin("orphan", "build_only", "removable")
    n, less = F.col("runtime_dependents"), F.col("closure_reduction")
    level = F.when(safe, "safe").when(n == 0, "low").when(n == 1, "medium").otherwise("high")
    text = (
        F.when(safe & (less > 0), F.format_string("Safe to remove. Would reduce closure by %d packages.", less))
        .when(safe, "Safe to remove. No closure impact.")
        .when(n == 1, F.concat(F.lit("Would break "), F.col("only"), F.lit(".")))
        .when(n > 1, F.format_string("Would break %d packages.", n))
        .otherwise("Cannot determine impact.")
    )
    return one.select(n.alias("affected_count"), "closure_reduction", safe.alias("removal_safe"), level.alias("impact_level"), text.alias("summary"))


def top_level_count(graph: Graph, node_id: int, max_depth: int = 20) -> DataFrame:
    """How many top-level packages need a node within some hops."""
    seeds = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    return reach(upward(graph.deps), seeds, max_depth).join(graph.nodes.where("is_top_level").select("id"), "id", "left_semi").agg(F.countDistinct("id").alias("top_level_dependents"))


def path_groups(graph: Graph, paths: DataFrame, max_groups: int | None = 10, max_packages: int = 5) -> DataFrame:
    """Paths by the node before the target; direct ones (length 1) form one group at the target itself.

    Each top-level package counts once in a group; the largest groups come first, the direct group before equals.
    """
    via = F.when(F.col("length") <= 1, F.element_at("path", -1)).otherwise(F.element_at("path", -2))
    each = paths.withColumn("via", via).groupBy("via", "top_id").agg(F.min("length").alias("length"), F.bool_or("is_runtime").alias("is_runtime"))
    tops = graph.nodes.select(F.col("id").alias("top_id"), F.col("label").alias("top_label"))
    each = each.join(tops, "top_id").withColumn("lower", F.lower("top_label"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "top_label"))), lambda x: x["top_label"]), ", ")
    shown = top_by(each, ["via"], [F.col("lower"), F.col("top_label"), F.col("top_id")], max_packages).groupBy("via").agg(names.alias("top_level_packages"))
    grouped = each.groupBy("via").agg(F.count("*").alias("total_dependents"), F.min("length").alias("shortest"), F.bool_or("is_runtime").alias("any_runtime")).join(shown, "via")
    grouped = grouped.join(graph.nodes.select(F.col("id").alias("via"), F.col("label").alias("via_label")), "via")
    return grouped if max_groups is None else grouped.orderBy(F.col("total_dependents").desc(), (F.col("shortest") <= 1).desc(), "via_label", "via").limit(max_groups)


def first_hop_groups(paths: DataFrame) -> DataFrame:
    """Paths by the node after the top-level package."""
    return paths.where("length > 0").groupBy(F.element_at("path", 2).alias("first_hop")).agg(F.count("*").alias("paths"), F.countDistinct("top_id").alias("top_level_packages"))


def summary_text(groups: DataFrame, paths: DataFrame, target: str) -> DataFrame:
    """A sentence on why the target is needed: the direct group, then the three largest others.

    A top-level package counts once, in however many groups it stands.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("total_dependents")).alias("n"), F.col("via_label").alias("v"), F.col("shortest").alias("s"), F.col("total_dependents").alias("d"), F.col("top_level_packages").alias("t"))))
    one = groups.agg(ordered.alias("g")).crossJoin(paths.agg(F.countDistinct("top_id").alias("total")))
    direct = F.filter("g", lambda x: x["s"] <= 1)
    other = F.filter("g", lambda x: x["s"] > 1)
    none = F.array().cast("array<string>")
    first = F.when(F.size(direct) == 0, none).when(direct[0]["d"] == 1, F.array(F.concat(F.lit("directly by "), direct[0]["t"]))).otherwise(F.array(F.format_string("directly by %d packages", direct[0]["d"])))
    then = F.transform(F.slice(other, 1, 3), lambda x: F.when(x["d"] == 1, F.concat(F.lit("via "), x["v"])).otherwise(F.format_string("via %s (%d)", x["v"], x["d"])))
    more = F.when(F.size(other) > 3, F.array(F.format_string("and %d more paths", F.size(other) - 3))).otherwise(none)
    needed = F.lit(f"{target} is needed by ")
    text = F.concat(needed, F.format_string("%d top-level packages: %s", F.col("total"), F.array_join(F.concat(first, then, more), ", ")))
    missing = f"{target} is not required by any top-level package"
    return one.select(F.when(F.size("g") == 0, missing).when(F.col("total") == 1, F.concat(needed, F.col("g")[0]["t"])).otherwise(text).alias("summary"))


def path_text(labels: Column) -> Column:
    """Labels of a path with arrows between."""
    return F.array_join(labels, " -> ")


def path_texts(graph: Graph, paths: DataFrame) -> DataFrame:
    """Each path in labels, from the top-level package down to the target."""
    each = paths.withColumn("key", F.array_join(F.col("path").cast("array<string>"), "→")).select("key", "top_id", F.posexplode(F.col("path")).alias("place", "id"))
    named = each.join(graph.nodes.select("id", "label"), "id")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])
    return named.groupBy("key", "top_id").agg(in_order.alias("labels")).select("top_id", F.col("key").alias("path"), path_text(F.col("labels")).alias("text"))


def group_texts(groups: DataFrame, shown: int = 5) -> DataFrame:
    """The packages of each group in one line, with how many more there are than ``path_groups`` shows."""
    rest = F.col("total_dependents") - shown
    more = F.when(rest > 0, F.format_string(" (+%d more)", rest)).otherwise("")
    return groups.select("via_label", F.concat(F.col("top_level_packages"), more).alias("text"))


def attribution_summary(graph: Graph) -> DataFrame:
    """Nodes, top-level packages and edges by type of an import, in one row."""
    nodes = graph.nodes.agg(F.count("*").alias("nodes"), F.count_if("is_top_level").alias("top_level"))
    kind = F.coalesce("dependency_type", F.lit("unknown"))
    edges = graph.edges.agg(F.count("*").alias("edges"), F.count_if(kind == "runtime").alias("runtime_edges"), F.count_if(kind == "build").alias("build_edges"), F.count_if(kind == "unknown").alias("unknown_edges"))
    return nodes.crossJoin(edges)


def module_breakdown(graph: Graph, paths: DataFrame) -> DataFrame:
    """The top-level packages of paths by kind of module, in a fixed order."""
    tops = paths.select(F.col("top_id").alias("id")).distinct().join(graph.nodes, "id")
    kind = F.coalesce("module_type", module_type(F.col("top_level_source")))
    place = F.array_position(F.array(*map(F.lit, ["systemPackages", "programs", "services", "other"])), F.col("kind"))
    return tops.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("packages"), F.countDistinct("top_level_source").alias("sources")).withColumn("place", place.cast("bigint"))


def primary_source(graph: Graph) -> DataFrame:
    """The kind of module that names more than half of the top-level packages, `mixed` if none does."""
    counts = graph.nodes.where("is_top_level").groupBy(F.coalesce("module_type", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))
    one = counts.agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return one.select(F.when(F.col("n") > 0.5 * F.col("total"), F.col("kind")).otherwise("mixed").alias("primary_source"), "total")


def sankey(graph: Graph, label: str, max_depth: int = 10, max_top_level: int | None = None, max_intermediate: int | None = None, app: str | None = None) -> DataFrame:
    """Links of all variants of a label: direct packages to the variant, others to the node before it and on.

    ``max_intermediate`` keeps the groups of most packages of each variant, ``max_top_level`` the first packages of each
    group by label, ``app`` those so labelled; a link into a variant counts all packages of its group unless ``app`` is given.
    """
    # a path ends at the first top-level package, so a variant that is one has no links
    variants = graph.nodes.where((F.col("label") == label) & ~F.coalesce("is_top_level", F.lit(False))).select(F.col("id").alias("seed"))
    steps = upward(graph.deps).distinct().withColumn("kind", F.lit(""))
    stops = graph.nodes.where("is_top_level").select(F.col("id").alias("stop"))
    via = F.when(F.size("path") > 2, F.element_at("path", 2))
    each = simple_paths(steps, variants, max_depth, stops).select(F.element_at("path", 1).alias("variant"), via.alias("via"), F.element_at("path", -1).alias("top_id")).distinct()
    each = each.withColumn("grp", F.coalesce("via", "variant"))
    groups = each.groupBy("variant", "grp", F.isnull("via").alias("direct")).agg(F.count("*").alias("total"))
    groups = groups.join(graph.nodes.select(F.col("id").alias("grp"), F.col("label").alias("grp_label")), "grp")
    if max_intermediate is not None:
        groups = top_by(groups, ["variant"], [F.col("total").desc(), F.col("direct").desc(), F.col("grp_label"), F.col("grp")], max_intermediate)
    tops = graph.nodes.select(F.col("id").alias("top_id"), F.col("label").alias("top_label"))
    shown = each.join(groups.select("variant", "grp", "total"), ["variant", "grp"]).join(tops, "top_id")
    if max_top_level is not None:
        shown = top_by(shown, ["variant", "grp"], [F.lower("top_label"), F.col("top_label"), F.col("top_id")], max_top_level)
    if app is not None:
        shown = shown.where(F.col("top_label") == app)
    upper = shown.select(F.col("top_id").alias("source"), F.col("grp").alias("target"), F.lit(1).cast("bigint").alias("value"))
    first = shown.where("via is not null").groupBy(F.col("via").alias("source"), F.col("variant").alias("target")).agg((F.max("total") if app is None else F.count("*")).alias("value"))
    return first.unionByName(upper).groupBy("source", "target").agg(F.sum("value").alias("value"))


def top_level_apps(graph: Graph, label: str, limit: int = 50) -> DataFrame:
    """Top-level packages over the variants of a label, one node per label, those of most closure first."""
    seeds = graph.nodes.where(F.col("label") == label).select(F.col("id").alias("seed"))
    tops = reach(upward(graph.deps), seeds).select("id").distinct().join(graph.nodes.where("is_top_level"), "id")
    once = tops.groupBy("label").agg(F.min_by(F.struct("id", F.coalesce("closure_size", F.lit(0)).alias("size")), "id").alias("n"))
    return once.select("label", F.col("n.id").alias("id"), F.col("n.size").alias("closure_size")).orderBy(F.col("closure_size").desc(), "label").limit(limit)


def csv_rows(groups: DataFrame, target: str) -> DataFrame:
    """One row per group for a CSV export."""
    return groups.select(F.lit(target).alias("target"), "via_label", "total_dependents", "shortest", "any_runtime", "top_level_packages")


def json_rows(groups: DataFrame) -> DataFrame:
    return groups.select("via_label", F.to_json(F.struct("via_label", "total_dependents", "shortest")).alias("json"))


def shortest_paths(graph: Graph, paths: DataFrame) -> DataFrame:
    """``(via, shortest_path, shortest_path_length, is_runtime_path)``: the shortest path of each group in labels, the first by its ids of equals."""
    via = F.when(F.col("length") <= 1, F.element_at("path", -1)).otherwise(F.element_at("path", -2))
    best = paths.groupBy(via.alias("via")).agg(F.min_by("path", F.struct("length", "path")).alias("path"))
    each = best.select("via", F.posexplode("path").alias("place", "id")).join(graph.nodes.select("id", "label", "package_type"), "id")
    labels = F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])
    built = F.bool_or(F.coalesce(F.col("package_type") == "build", F.lit(False)))
    return each.groupBy("via").agg(labels.alias("labels"), built.alias("built")).select("via", path_text(F.col("labels")).alias("shortest_path"), (F.size("labels") - 1).cast("bigint").alias("shortest_path_length"), F.when(F.col("built"), "no").otherwise("yes").alias("is_runtime_path"))


def why_chain(graph: Graph, node_id: int, paths: DataFrame, max_groups: int = 10) -> DataFrame:
    """Why a node is there, in one row: itself, how many packages, paths and direct dependents it has, its status and its groups."""
    own = graph.nodes.where(F.col("id") == node_id).select("id", "label", "drv_hash", "package_type")
    direct = graph.deps.where(F.col("dependency") == node_id).agg(F.countDistinct("dependent").alias("direct_dependents"))
    counts = paths.agg(F.countDistinct("top_id").alias("total_top_level_dependents"), F.count("*").alias("total_paths_found"))
    place = F.struct((-F.col("total_dependents")).alias("n"), (F.col("shortest") > 1).alias("far"), F.col("via_label").alias("v"), F.col("via").alias("i"))
    groups = path_groups(graph, paths, max_groups).agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["v"]), ", ").alias("via"))
    return own.crossJoin(counts).crossJoin(direct).crossJoin(essentiality(paths).select(F.col("status").alias("essentiality"))).crossJoin(groups)


def attribution_export(graph: Graph, node_id: int, paths: DataFrame, max_groups: int = 10, shown: int = 10) -> DataFrame:
    """One row per group with the target's own columns and the group's shortest path; a node without paths has one row that says so."""
    chain = why_chain(graph, node_id, paths, max_groups)
    groups = path_groups(graph, paths, max_groups, shown).join(shortest_paths(graph, paths), "via", "left").withColumn("target", F.lit(node_id))
    rest = F.col("total_dependents") - shown
    packages = F.concat("top_level_packages", F.when(rest > 0, F.format_string(" (+%d more)", rest)).otherwise(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return chain.join(groups.withColumn("packages", packages), chain["id"] == groups["target"], "left").select(
        F.col("label").alias("target_package"), text(F.substring("drv_hash", 1, 12)).alias("target_hash"), F.col("essentiality").alias("essentiality_status"), "total_top_level_dependents",
        F.coalesce("via_label", F.lit("(no attribution paths)")).alias("via_package"), text(groups["via"].cast("string")).alias("via_node_id"), number("total_dependents").alias("group_dependent_count"),
        text(F.col("packages")).alias("top_level_packages"), text(F.col("shortest_path")).alias("shortest_path"), number("shortest_path_length").alias("shortest_path_length"), text(F.col("is_runtime_path")).alias("is_runtime_path"),
    )


def attribution_markdown(rows: DataFrame) -> DataFrame:
    """``(place, line)`` of a report on ``attribution_export``: the target and its status, then a line per group, the largest first."""
    head = F.concat(F.lit("# Why "), "target_package", F.lit("? ("), "essentiality_status", F.format_string(", %d top-level packages)", "total_top_level_dependents"))
    line = F.concat(F.lit("- **"), "via_package", F.lit("**: "), F.col("group_dependent_count").cast("string"), F.when(F.col("shortest_path") != "", F.concat(F.lit(", `"), "shortest_path", F.lit("`"))).otherwise(""))
    place = lambda n, name: F.struct(n.cast("bigint").alias("n"), name.alias("name"))
    heads = rows.select(head.alias("line"), place(F.lit(-(10**15)), F.lit("")).alias("place")).distinct()
    return heads.select("place", "line").unionByName(rows.select(place(-F.col("group_dependent_count"), F.concat("via_package", F.lit(" "), "via_node_id")).alias("place"), line.alias("line")))
