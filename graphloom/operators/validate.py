"""Checks of an import as rows (check_name, severity, affected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph

EDGE_TYPES = ("build", "runtime", "unknown")


def _issues(one: DataFrame, checks: list[tuple[str, str, str | Column]]) -> DataFrame:
    """A row for each check whose count in the one-row frame is above 0."""
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.lit(level).alias("severity"), (F.col(n) if isinstance(n, str) else n).cast("bigint").alias("affected")) for name, level, n in checks])
    return one.select(F.explode(rows).alias("i")).select("i.*").where("affected > 0")


def edge_classification(graph: Graph) -> DataFrame:
    kind = F.col("dependency_type")
    one = graph.edges.agg(F.count("*").alias("n"), F.count_if(kind.isNull()).alias("missing"), F.count_if(kind.isNotNull() & ~kind.isin(*EDGE_TYPES)).alias("invalid"), F.count_if(kind == "unknown").alias("unknown"))
    high, some = F.col("unknown") > 0.5 * F.col("n"), (F.col("unknown") > 0.2 * F.col("n")) & (F.col("unknown") <= 0.5 * F.col("n"))
    return _issues(one, [("edge_type_missing", "error", "missing"), ("edge_type_invalid", "error", "invalid"), ("edge_type_mostly_unknown", "warning", F.when(high, F.col("unknown")).otherwise(0)), ("edge_type_often_unknown", "info", F.when(some, F.col("unknown")).otherwise(0))])


def top_level_identification(graph: Graph) -> DataFrame:
    top, source = F.col("is_top_level"), F.col("top_level_source")
    one = graph.nodes.agg(F.count("*").alias("n"), F.count_if(top).alias("top"), F.count_if(top & source.isNull()).alias("no_source"), F.count_if(~top & source.isNotNull()).alias("orphan_source"), F.countDistinct(F.when(top, source)).alias("sources"))
    return _issues(one, [("no_top_level", "warning", F.when(F.col("top") == 0, 1).otherwise(0)), ("top_level_without_source", "warning", "no_source"), ("source_without_top_level", "error", "orphan_source"), ("mostly_top_level", "warning", F.when(F.col("top") > 0.5 * F.col("n"), F.col("top")).otherwise(0)), ("source_distribution", "info", "sources")])


def closure_contribution(contributions: DataFrame) -> DataFrame:
    """Over top-level rows with the three contributions."""
    u, s, t = F.col("unique_contribution"), F.col("shared_contribution"), F.col("total_contribution")
    done = u.isNotNull() & s.isNotNull() & t.isNotNull()
    one = contributions.agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if((u < 0) | (s < 0) | (t < 0)).alias("negative"), F.count_if(done & (t != u + s)).alias("sum_off"), F.count_if((u > t) | (s > t)).alias("part_over"))
    return _issues(one, [("contribution_missing", "info", F.col("n") - F.col("done")), ("contribution_negative", "error", "negative"), ("contribution_sum", "error", "sum_off"), ("contribution_part", "error", "part_over"), ("contribution_computed", "info", "done")])


def referential_integrity(graph: Graph, all_nodes: DataFrame) -> DataFrame:
    """Edges whose ends are missing or belong to another import."""
    ends = all_nodes.select("id", F.col("import_id").alias("end_import"))
    checked = graph.edges.join(ends.select(F.col("id").alias("source_id"), F.col("end_import").alias("si")), "source_id", "left").join(ends.select(F.col("id").alias("target_id"), F.col("end_import").alias("ti")), "target_id", "left")
    one = checked.agg(F.count_if(F.col("si").isNull()).alias("no_source"), F.count_if(F.col("ti").isNull()).alias("no_target"), F.count_if((F.col("si") != F.col("import_id")) | (F.col("ti") != F.col("import_id"))).alias("across"))
    return _issues(one, [("orphan_source", "error", "no_source"), ("orphan_target", "error", "no_target"), ("cross_import", "error", "across")])


def data_consistency(graph: Graph) -> DataFrame:
    nodes = graph.nodes.agg(
        F.count("*").alias("n"), F.count_if(F.col("depth") < 0).alias("bad_depth"), F.count_if(F.col("closure_size") < 0).alias("bad_closure"), F.count_if(F.coalesce("drv_hash", F.lit("")) == "").alias("no_hash"),
        F.count_if(F.coalesce("label", F.lit("")) == "").alias("no_label"), F.count("depth").alias("with_depth"), F.count("closure_size").alias("with_closure"),
    )
    one = nodes.crossJoin(graph.edges.agg(F.count_if(F.col("source_id") == F.col("target_id")).alias("self_edges")))
    few = lambda c: F.when(F.col(c) < 0.9 * F.col("n"), F.col("n") - F.col(c)).otherwise(0)
    return _issues(one, [("self_edge", "warning", "self_edges"), ("negative_depth", "error", "bad_depth"), ("negative_closure", "error", "bad_closure"), ("empty_hash", "error", "no_hash"), ("empty_label", "warning", "no_label"), ("depth_coverage", "warning", few("with_depth")), ("closure_coverage", "warning", few("with_closure"))])


def everything(graph: Graph, all_nodes: DataFrame, contributions: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [edge_classification(graph), top_level_identification(graph), closure_contribution(contributions), referential_integrity(graph, all_nodes), data_consistency(graph)])


def verdict(issues: DataFrame) -> DataFrame:
    """Counts by severity; an import passes without errors."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("infos")).withColumn("passed", F.col("errors") == 0)


def phase_report(graph: Graph, contributions: DataFrame) -> DataFrame:
    """Six checks with their status and counts, whether or not something is wrong."""
    edges = graph.edges.agg(F.count_if(F.col("dependency_type").isNull()).alias("a"), F.count_if(F.col("source_id") == F.col("target_id")).alias("b"))
    nodes = graph.nodes.agg(F.count_if(F.col("is_top_level") & F.col("top_level_source").isNull()).alias("c"), F.count_if(~F.col("is_top_level") & F.col("top_level_source").isNotNull()).alias("d"))
    parts = contributions.agg(F.count_if(F.col("total_contribution") != F.col("unique_contribution") + F.col("shared_contribution")).alias("e"), F.count_if((F.col("unique_contribution") < 0) | (F.col("shared_contribution") < 0)).alias("f"))
    names = [("edge_classification", "a"), ("self_edges", "b"), ("top_level_source", "c"), ("orphan_source", "d"), ("contribution_sum", "e"), ("contribution_sign", "f")]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.when(F.col(c) == 0, "PASS").otherwise("FAIL").alias("status"), F.col(c).alias("affected")) for n, c in names])
    return edges.crossJoin(nodes).crossJoin(parts).select(F.explode(rows).alias("i")).select("i.*")
