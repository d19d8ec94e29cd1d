"""What top-level packages add to the closure, and keeping those figures fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import Graph
from . import usage
from .fixpoint import checkpointed, reach, upward


def contributions(graph: Graph) -> DataFrame:
    """``(id, unique_contribution, shared_contribution, total_contribution)`` of top-level nodes with dependencies.

    A dependency is unique to a package if no other top-level package of the import has it in its closure. States of one
    user or many tell, and closures are counted as sets; no table of packages and dependencies is made.
    """
    return usage.Kept.of(graph).contributions


def named(graph: Graph, found: DataFrame) -> DataFrame:
    return found.join(graph.nodes.select("id", "label", "package_type", "top_level_source"), "id")


def ranked(found: DataFrame, sort_by: str = "unique", limit: int = 20) -> DataFrame:
    """Contributions by `unique`, `total` or `label`."""
    order = {"unique": F.col("unique_contribution").desc(), "total": F.col("total_contribution").desc(), "label": F.col("label").asc()}[sort_by]
    return found.orderBy(order, "label", "id").limit(limit)


def unique_share(unique: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * unique / total).otherwise(0.0)


def removal_text(unique: Column, total: Column) -> Column:
    share = unique_share(unique, total)
    level = F.when(share > 75, "High").when(share > 25, "Medium").otherwise("Low")
    text = F.format_string("%s impact - %d unique deps would be removed", level, unique)
    return F.when(unique == 0, "No unique dependencies - safe to remove").otherwise(text)


def summary(found: DataFrame) -> DataFrame:
    """Totals over top-level packages, the mean of unique ones, and the share that is shared."""
    total = F.sum("total_contribution")
    return found.agg(
        F.count("*").alias("top_level_count"), F.sum("unique_contribution").alias("unique_sum"), F.sum("shared_contribution").alias("shared_sum"), total.alias("total_sum"),
        F.round(F.avg("unique_contribution"), 6).alias("average_unique"), F.round(F.sum("shared_contribution") / total, 6).alias("sharing_ratio"),
    )


def removal_candidates(found: DataFrame, max_unique: int = 0, limit: int = 20) -> DataFrame:
    return found.where(F.col("unique_contribution") <= max_unique).orderBy("unique_contribution", F.col("shared_contribution").desc(), "label", "id").limit(limit)


def by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("package_type").agg(F.count("*").alias("packages"), F.sum("unique_contribution").alias("unique_sum"), F.sum("shared_contribution").alias("shared_sum"), F.sum("total_contribution").alias("total_sum"))


def contribution_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right less left by label, where a side without the label counts 0."""
    columns = ["unique_contribution", "total_contribution"]
    side = lambda df, s: df.groupBy("label").agg(*[F.sum(c).alias(f"{s}_{c}") for c in columns])
    both = side(left, "l").join(side(right, "r"), "label", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("label", (zero("r_unique_contribution") - zero("l_unique_contribution")).alias("unique_diff"), (zero("r_total_contribution") - zero("l_total_contribution")).alias("total_diff"))


def staleness(computed: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Over ``computed(id, computed_at)``: rows never computed, rows older than the threshold, and the oldest and newest."""
    limit = F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return computed.agg(
        F.count("*").alias("top_level_count"), F.count_if(F.col("computed_at").isNull()).alias("never"), F.count_if(F.col("computed_at") < limit).alias("stale"),
        F.date_format(F.min("computed_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest"), F.date_format(F.max("computed_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"),
    )


def staleness_by_source(computed: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    limit = F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return computed.groupBy("top_level_source").agg(F.count("*").alias("packages"), F.count_if(F.col("computed_at").isNull() | (F.col("computed_at") < limit)).alias("stale"))


def marked_stale(computed: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Without times for ``ids(id)``, or for all."""
    if ids is None:
        return computed.withColumn("computed_at", F.lit(None).cast("timestamp_ntz"))
    hit = ids.select("id", F.lit(True).alias("hit")).distinct()
    return computed.join(hit, "id", "left").withColumn("computed_at", F.when(F.col("hit").isNull(), F.col("computed_at"))).drop("hit")


def stale_ids(computed: DataFrame, as_of: str, hours: int = 24, limit: int | None = None) -> DataFrame:
    """Stale rows, those never computed first, then the oldest."""
    edge = F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(hours))
    rows = computed.where(F.col("computed_at").isNull() | (F.col("computed_at") < edge))
    return rows if limit is None else rows.orderBy(F.col("computed_at").asc_nulls_first(), "id").limit(limit)


def recomputed(graph: Graph, ids: DataFrame, kept: usage.Kept | None = None) -> DataFrame:
    """Fresh contributions of ``ids(id)``: only what they depend on is counted; who else uses it is in the states kept, or found first."""
    return usage.contributions_of(graph, usage.states(graph) if kept is None else kept.states, ids)


def affected_by_edge(graph: Graph, target_id: int) -> DataFrame:
    """Top-level packages whose closure, or which themselves, hold the edge's target."""
    return affected_by_node(graph, target_id)


def affected_by_node(graph: Graph, node_id: int) -> DataFrame:
    seeds = graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed"))
    up = reach(upward(graph.deps), seeds).select("id").unionByName(seeds.select(F.col("seed").alias("id"))).distinct()
    return graph.nodes.where("is_top_level").join(up, "id", "left_semi").select("id", "label")


def affected_by_top_level(graph: Graph) -> DataFrame:
    return graph.nodes.where("is_top_level").select("id", "label")


def affected_by_change(graph: Graph, change: str, node_id: int | None = None) -> DataFrame:
    """Top-level packages that a change of kind `edge`, `node`, `top_level` or `import` makes stale."""
    if change in ("top_level", "import"):
        return affected_by_top_level(graph)
    return affected_by_node(graph, node_id)


def needs_recomputation(computed: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Whether any contribution was never computed or is older than the threshold."""
    return stale_ids(computed, as_of, hours).agg((F.count("*") > 0).alias("needs_recomputation"))


def recompute_stale(graph: Graph, computed: DataFrame, as_of: str, hours: int = 24, max_nodes: int | None = None, kept: usage.Kept | None = None) -> DataFrame:
    """Fresh contributions where they are stale, with the strategy: all of them if over half are stale, else only those."""
    stale = checkpointed(stale_ids(computed, as_of, hours, max_nodes).select("id"))
    full = stale.count() > 0.5 * computed.count()
    rows = contributions(graph) if full else recomputed(graph, stale, kept)
    return rows.withColumn("strategy", F.lit("full" if full else "selective"))


def recompute_all_stale(graph: Graph, computed: DataFrame, as_of: str, hours: int = 24, max_nodes: int | None = None) -> DataFrame:
    """Fresh contributions with their import, wherever they are stale in any import; imports without stale ones are not looked at."""
    stale = checkpointed(stale_ids(computed, as_of, hours, max_nodes).select("id"))
    which = graph.nodes.join(stale, "id", "left_semi").select("import_id").distinct()
    these = Graph(graph.nodes.join(which, "import_id", "left_semi"), graph.edges.join(which, "import_id", "left_semi"))
    return recomputed(these, stale).join(these.nodes.select("id", "import_id"), "id")


def recomputation_cost(top: DataFrame, stale: DataFrame) -> DataFrame:
    """Estimated milliseconds of a full and of an incremental recomputation, what is saved, and which to take."""
    both = top.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce("closure_size", F.lit(0))), F.lit(0.0)).alias("mean")).crossJoin(stale.agg(F.count("*").alias("stale")))
    each = 10.0 * (1 + F.col("mean") / 1000.0)
    full, part = F.col("n") * each, F.col("stale") * each
    advice = F.when(F.col("stale") == 0, "none").when(F.col("stale") > 0.5 * F.col("n"), "full").otherwise("incremental")
    return both.select(F.col("n").alias("top_level_count"), F.col("stale").alias("stale_count"), F.round(full, 6).alias("full_ms"), F.round(part, 6).alias("incremental_ms"), F.round(F.when(full > 0, 100 * (full - part) / full).otherwise(0.0), 6).alias("savings_percent"), advice.alias("recommendation"))


def last_computation(computed: DataFrame) -> DataFrame:
    return computed.agg(F.date_format(F.max("computed_at"), "yyyy-MM-dd HH:mm:ss").alias("last_computed"))


def latest_only(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_turn = 1").drop("_turn")
