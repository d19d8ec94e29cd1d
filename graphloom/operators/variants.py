"""Variants of a package and what needs each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from .fixpoint import top_by

MAX_VARIANTS, MAX_DEPENDENTS, MAX_APPLICATIONS = 20, 50, 100


def _variants(graph: Graph, label: str, max_variants: int) -> DataFrame:
    return graph.nodes.where(F.col("label") == label).orderBy("drv_hash", "id").limit(max_variants).select(F.col("id").alias("variant_id"), "drv_hash")


def variant_matrix(graph: Graph, label: str, *, max_variants: int = MAX_VARIANTS, max_dependents: int = MAX_DEPENDENTS, top_level_only: bool = False, kind: str | None = None) -> DataFrame:
    """Long form: a row per application and variant with ``has_dep`` and ``dep_type``.

    Per variant the top-level dependents first, then by label, up to ``max_dependents``; the applications are their
    union, up to a hundred by label.
    """
    variants = _variants(graph, label, max_variants)
    deps = graph.deps if kind is None else graph.deps.where(F.col("dep_type") == kind)
    names = graph.nodes.select(F.col("id").alias("dependent"), F.col("label").alias("app"), "is_top_level")
    cells = variants.join(deps, F.col("variant_id") == F.col("dependency")).join(names, "dependent")
    if top_level_only:
        cells = cells.where("is_top_level")
    cells = top_by(cells, ["variant_id"], [F.col("is_top_level").desc(), F.col("app"), F.col("dependent")], max_dependents)
    apps = cells.select("dependent", "app").distinct().orderBy("app", "dependent").limit(MAX_APPLICATIONS)
    # at most a hundred applications by twenty variants
    grid = apps.join(F.broadcast(variants.select("variant_id", "drv_hash")), F.lit(True))
    marked = cells.select("dependent", "variant_id", "dep_type")
    return grid.join(marked, ["dependent", "variant_id"], "left").select("app", "drv_hash", F.col("dep_type").isNotNull().alias("has_dep"), "dep_type")


def variant_order(graph: Graph, label: str, sort_by: str = "dependent_count", *, max_variants: int = MAX_VARIANTS, kind: str | None = None) -> DataFrame:
    """``(id, drv_hash, dependents, rank)`` of a label's variants by `dependent_count`, `hash` or `closure_size`, with all dependents counted."""
    own = graph.nodes.where(F.col("label") == label).select("id", "drv_hash", F.coalesce("closure_size", F.lit(0)).alias("size"))
    deps = graph.deps if kind is None else graph.deps.where(F.col("dep_type") == kind)
    found = own.join(deps, F.col("id") == F.col("dependency"), "left").groupBy("id", "drv_hash", "size").agg(F.countDistinct("dependent").alias("dependents"))
    first = {"hash": [], "closure_size": [F.col("size").desc()], "dependent_count": [F.col("dependents").desc()]}[sort_by]
    return top_by(found.withColumn("one", F.lit(1)), ["one"], [*first, F.col("drv_hash"), F.col("id")], max_variants).select("id", "drv_hash", "dependents", "rank")


def variant_types(graph: Graph, label: str) -> DataFrame:
    """One dependency type per variant: its own, `mixed`, or none."""
    variants = graph.nodes.where(F.col("label") == label).select(F.col("id").alias("variant_id"), "drv_hash")
    kinds = variants.join(graph.deps, F.col("variant_id") == F.col("dependency"), "left").groupBy("drv_hash").agg(F.collect_set("dep_type").alias("kinds"), F.count("dep_type").alias("dependents"))
    return kinds.select("drv_hash", "dependents", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).when(F.size("kinds") > 1, "mixed").alias("dep_type"))


def variant_labels(graph: Graph, least: int = 2, limit: int = 50) -> DataFrame:
    """Labels with several hashes, and how many distinct nodes need them."""
    often = graph.nodes.groupBy("label").agg(F.countDistinct("drv_hash").alias("variants")).where(F.col("variants") >= least)
    needed = graph.nodes.select("id", "label").join(graph.deps, F.col("id") == F.col("dependency")).groupBy("label").agg(F.countDistinct("dependent").alias("dependents"))
    return often.join(needed, "label", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0))).orderBy(F.col("variants").desc(), F.col("dependents").desc(), "label").limit(limit)


def variant_summary(graph: Graph, label: str) -> DataFrame:
    own = graph.nodes.where(F.col("label") == label)
    users = own.select("id").join(graph.deps, F.col("id") == F.col("dependency")).agg(F.countDistinct("dependent").alias("dependents"))
    return own.agg(F.count("*").alias("nodes"), F.countDistinct("drv_hash").alias("variants"), F.sum(F.coalesce("closure_size", F.lit(0))).alias("total_closure")).crossJoin(users)
