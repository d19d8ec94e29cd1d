"""Differences between two imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.graph import Graph
from .fixpoint import simple_paths, stored, top_by, upward

#: Copies of a label on the left from which its pairs are dealt to several units.
UNIT_COPIES = 1_024


def _sides(left: Graph, right: Graph) -> tuple[DataFrame, DataFrame]:
    depth = lambda g: F.col("depth") if "depth" in g.nodes.columns else F.lit(None).cast("bigint")
    side = lambda g, s: g.nodes.select(depth(g).alias(f"{s}_depth"), F.col("label").alias(f"{s}_label"), F.col("id").alias(f"{s}_id"), F.col("drv_hash").alias(f"{s}_hash"), F.col("package_type").alias(f"{s}_type"), F.col("closure_size").alias(f"{s}_closure"), F.col("is_top_level").alias(f"{s}_top"))
    return side(left, "l"), side(right, "r")


def diffs(left: Graph, right: Graph) -> DataFrame:
    """Full outer join by label; equal labels on a side multiply. The package type is that of the left if it has one."""
    l, r = _sides(left, right)
    return _rows(l.join(r, F.col("l_label") == F.col("r_label"), "full_outer"))


def lone_diffs(left: Graph, right: Graph) -> DataFrame:
    """The rows of ``diffs`` whose label only one side has; no pair is made."""
    l, r = _sides(left, right)
    only = lambda a, b, on: a.join(b.groupBy(on[1]).agg(F.lit(1)).select(on[1]), F.col(on[0]) == F.col(on[1]), "left_anti")
    return _rows(only(l, r, ("l_label", "r_label")).unionByName(only(r, l, ("r_label", "l_label")), allowMissingColumns=True))


def sided_diffs(left: Graph, right: Graph) -> DataFrame:
    """The rows of ``diffs`` of kind `only_left` and `only_right`: ``lone_diffs``, and pairs with a node that has no id."""
    l, r = _sides(left, right)
    paired = lambda a, b: _rows(a.join(b, F.col("l_label") == F.col("r_label")))
    without = paired(l.where("l_id is null"), r).unionByName(paired(l.where("l_id is not null"), r.where("r_id is null")))
    return lone_diffs(left, right).unionByName(without)


def many_copies(left: Graph, right: Graph) -> DataFrame:
    """``(many_label, l_n, r_n)``, stored: labels that more than 1,024 nodes of a side have, and how many have them. A row for a thousand nodes at most."""
    side = lambda g, l, r: g.nodes.where("label is not null").select(F.col("label").alias("many_label"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    counts = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy("many_label").agg(F.sum("l").alias("l_n"), F.sum("r").alias("r_n"))
    return stored(counts.where((F.col("l_n") > UNIT_COPIES) | (F.col("r_n") > UNIT_COPIES)))


def dealt_sides(l: DataFrame, r: DataFrame, many: DataFrame, made: Callable[[DataFrame, str], DataFrame] = lambda df, s: df, *, in_place: bool = False) -> DataFrame:
    """The full outer join of ``_sides`` by label. Nodes are shuffled once, or lie by label (``in_place``), and nothing of pairs is sorted or stored.

    The pairs of a label of ``many`` are made in units of some 1,024 of its copies on the left, which all tasks share; others
    meet by label, 1,024 of a side at most. ``made(side, "l" or "r")`` adds what is made once for each node, where it was shuffled to.
    """
    parts = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    label = lambda s: F.col(f"{s}_label")
    by_label = lambda df, s: df if in_place else df.repartition(parts, f"{s}_label")
    few = lambda df, s: made(by_label(df.where(label(s).isNotNull()).join(F.broadcast(many), label(s) == F.col("many_label"), "left_anti"), s), s)
    both = few(l, "l").join(few(r, "r"), label("l") == label("r"), "full_outer")
    units = F.ceil(F.col("l_n") / UNIT_COPIES).cast("int")
    of_many = lambda df, s: df.join(F.broadcast(many), label(s) == F.col("many_label"))
    unit = {"l": F.pmod(F.xxhash64("l_id", "l_hash"), units).cast("int"), "r": F.explode(F.sequence(F.lit(0), units - 1))}
    dealt = lambda df, s: made(of_many(df, s).where("l_n > 0 and r_n > 0").withColumn(f"{s}_unit", unit[s]).drop(*many.columns).repartition(parts, f"{s}_label", f"{s}_unit"), s)
    pairs = dealt(l, "l").hint("merge").join(dealt(r, "r"), (label("l") == label("r")) & (F.col("l_unit") == F.col("r_unit"))).drop("l_unit", "r_unit")
    alone = lambda df, s, other: made(df.where(label(s).isNull()).unionByName(of_many(df, s).where(f"{other}_n = 0").drop(*many.columns)), s)
    rest = alone(l, "l", "r").unionByName(alone(r, "r", "l"), allowMissingColumns=True)
    return both.unionByName(pairs).unionByName(rest)


def dealt_diffs(left: Graph, right: Graph) -> DataFrame:
    """The rows of ``diffs`` with their category and the version of the label, by ``dealt_sides``."""

    def described(df: DataFrame, s: str) -> DataFrame:
        label = F.col(f"{s}_label")
        return df.withColumns({f"{s}_category": L.category(label, F.col(f"{s}_type")), f"{s}_version": L.version_parts(label)[1]})

    both = dealt_sides(*_sides(left, right), many_copies(left, right), described)
    # the category is that of the side whose type counts
    category = F.when(F.col("l_type").isNotNull(), F.col("l_category")).otherwise(F.coalesce("r_category", "l_category"))
    return _rows(both, category.alias("category"), F.coalesce("l_version", "r_version").alias("version"))


def numbered(rows: DataFrame, place: list[str], size: str = "1") -> DataFrame:
    """With ``number``: how many lines come before a row in the order of ``place``, where a row stands for ``size`` lines.

    Rows are range-partitioned by their place, so that each task numbers its own; only one sum a task is put in order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *place).withColumns({"task": F.spark_partition_id(), "lines": F.expr(size).cast("bigint")}))
    before = lambda window: F.coalesce(F.sum("lines").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("task").agg(F.sum("lines").alias("lines")).select("task", before(Window.orderBy("task")).alias("start"))
    inside = dealt.withColumn("number", before(Window.partitionBy("task").orderBy(*place)))
    return inside.join(F.broadcast(starts), "task").withColumn("number", F.col("start") + F.col("number")).drop("task", "lines", "start")


def counted_sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of ``numbered_pairs``: nodes that are in a pair of one label whose hashes aren't equal, and in no pair without an id, with what gives the pairs' numbers.

    A node of the left has ``number``, the pairs before its first one, from counts by label and hash. The right lies in blocks
    of 1,024 nodes of one label at most, in order; the left knows how many of its own hash are in each.
    """
    whole = lambda df, s: df.where(F.col(f"{s}_label").isNotNull() & F.col(f"{s}_id").isNotNull())
    left = whole(left, "l")
    right = stored(numbered(whole(right, "r"), ["r_label", "r_id"]).withColumnRenamed("number", "r_at").withColumn("block", F.floor(F.col("r_at") / UNIT_COPIES)))
    copies = left.groupBy("l_label").agg(F.ceil(F.count("*") / UNIT_COPIES).alias("units"))
    by_label = right.groupBy("r_label").agg(F.count("*").alias("r_copies"), F.min("r_at").alias("r_first")).join(copies, F.col("r_label") == F.col("l_label")).drop("l_label")
    by_block = right.where("r_hash is not null").groupBy("r_label", "r_hash", "block").agg(F.count("*").alias("n"))
    by_hash = by_block.groupBy(F.col("r_label").alias("same_label"), F.col("r_hash").alias("same_hash")).agg(F.sum("n").alias("n_same"), F.collect_list(F.struct("block", "n")).alias("same"))
    counted = left.join(by_label, F.col("l_label") == F.col("r_label")).join(by_hash, (F.col("l_label") == F.col("same_label")) & (F.col("l_hash") == F.col("same_hash")), "left")
    counted = counted.withColumn("n_pairs", F.col("r_copies") - F.coalesce("n_same", F.lit(0))).where("n_pairs > 0").drop("r_label", "same_label", "same_hash", "n_same")
    l = numbered(counted, ["l_label", "l_id"], "n_pairs").drop("n_pairs")
    wanted = l.groupBy(F.col("l_label").alias("wanted")).agg(F.max("units").alias("units"))
    return l, right.join(wanted, F.col("r_label") == F.col("wanted")).drop("wanted")


def numbered_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs from ``counted_sides``, with ``number``: how many come before a pair in the order of label, ``l_id`` and ``r_id``.

    A row of the left meets a block of the right and numbers its pairs itself, so pairs are neither sorted nor stored. What is
    dealt to tasks is a block and 1,024 copies of its label on the left.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = [c for c in left.columns if c not in ("number", "units", "r_copies", "r_first", "same")]
    node = F.struct("r_at", *[c for c in right.columns if c not in ("r_at", "r_label", "block", "units")])
    blocks = right.groupBy("r_label", "block", "units").agg(F.min("r_at").alias("begins"), F.sort_array(F.collect_list(node)).alias("nodes"))
    r = blocks.withColumn("r_unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("units") - 1))).drop("units").repartition(parts, "r_label", "block", "r_unit")
    block = lambda at: F.floor(at / UNIT_COPIES)
    l = left.withColumn("l_unit", F.pmod(F.xxhash64("l_id"), "units")).withColumn("l_block", F.explode(F.sequence(block(F.col("r_first")), block(F.col("r_first") + F.col("r_copies") - 1)))).repartition(parts, "l_label", "l_block", "l_unit")
    both = l.join(r, (F.col("l_label") == F.col("r_label")) & (F.col("l_block") == F.col("block")) & (F.col("l_unit") == F.col("r_unit")))
    same = F.aggregate(F.filter("same", lambda x: x["block"] < F.col("block")), F.lit(0).cast("bigint"), lambda total, x: total + x["n"])
    first = F.col("number") + F.col("begins") - F.col("r_first") - F.coalesce(same, F.lit(0))
    other = F.filter("nodes", lambda x: ~F.coalesce(F.col("l_hash") == x["r_hash"], F.lit(False)))
    # outer, since Spark would filter the list a second time to see whether it is empty
    found = both.select(*side, first.alias("first"), other.alias("other")).select(*side, "first", F.posexplode_outer("other").alias("at", "r")).where("at is not null")
    return found.select(*side, "r.*", (F.col("first") + F.col("at")).alias("number")).drop("r_at")


def _kind() -> Column:
    return F.when(F.col("l_id").isNull(), "only_right").when(F.col("r_id").isNull(), "only_left").when(F.col("l_hash") == F.col("r_hash"), "same").otherwise("different")


def _rows(both: DataFrame, *more: Column) -> DataFrame:
    impact = F.coalesce("r_closure", F.lit(0)) - F.coalesce("l_closure", F.lit(0))
    return both.select(
        F.coalesce("l_label", "r_label").alias("label"), F.coalesce("l_type", "r_type").alias("package_type"), _kind().alias("diff_type"), "l_id", "r_id", "l_hash", "r_hash",
        impact.alias("closure_impact"), F.coalesce("l_top", "r_top").alias("is_top_level"), "l_closure", "r_closure", "l_top", "r_top", "l_depth", "r_depth", *more,
    )


def diff_groups(left: Graph, right: Graph) -> DataFrame:
    """The rows of ``diffs`` counted by label, type and kind of difference: ``(label, package_type, diff_type, n, closure_impact)``.

    Pairs of a label are the product of its counts on the two sides, those of one hash the product within the hash, and so
    with closures, so no pair is made: rows are at most a label's types on either side. Counts of ``found`` take them as well.
    """

    def side(g: Graph, s: str, *keys: str) -> DataFrame:
        return g.nodes.select(*[F.col(c).alias(f"{s}_{c}") for c in ("label", "package_type", *keys)], F.coalesce("closure_size", F.lit(0)).cast("decimal(38,0)").alias("size")).groupBy(*[f"{s}_{c}" for c in ("label", "package_type", *keys)]).agg(F.count("*").alias(f"{s}_n"), F.sum("size").cast("decimal(38,0)").alias(f"{s}_size"))

    many = lambda n: F.col(n).cast("decimal(19,0)")
    made = (many("l_n") * many("r_n")).cast("decimal(38,0)")
    impact = F.when(F.col("l_n").isNull(), F.col("r_size")).when(F.col("r_n").isNull(), -F.col("l_size")).otherwise(F.col("r_size") * many("l_n") - F.col("l_size") * many("r_n")).cast("decimal(38,0)")
    by_label = side(left, "l").join(side(right, "r"), F.col("l_label") == F.col("r_label"), "full_outer")
    by_hash = side(left, "l", "drv_hash").join(side(right, "r", "drv_hash"), (F.col("l_label") == F.col("r_label")) & (F.col("l_drv_hash") == F.col("r_drv_hash")))
    one = F.when(F.col("l_n").isNull(), many("r_n")).when(F.col("r_n").isNull(), many("l_n")).otherwise(made).cast("decimal(38,0)")
    all_pairs = by_label.select(F.coalesce("l_label", "r_label").alias("label"), F.coalesce("l_package_type", "r_package_type").alias("package_type"), F.when(F.col("l_n").isNull(), "only_right").when(F.col("r_n").isNull(), "only_left").otherwise("different").alias("diff_type"), one.alias("n"), impact.alias("closure_impact"))
    same = by_hash.select(F.col("l_label").alias("label"), F.coalesce("l_package_type", "r_package_type").alias("package_type"), made.alias("n"), impact.alias("closure_impact"))
    # pairs of one hash are among those of the label
    less = same.select("label", "package_type", F.lit("different").alias("diff_type"), (-F.col("n")).cast("decimal(38,0)").alias("n"), (-F.col("closure_impact")).cast("decimal(38,0)").alias("closure_impact"))
    rows = all_pairs.unionByName(same.withColumn("diff_type", F.lit("same")).select(all_pairs.columns)).unionByName(less)
    return rows.groupBy("label", "package_type", "diff_type").agg(F.sum("n").cast("bigint").alias("n"), F.sum("closure_impact").cast("bigint").alias("closure_impact")).where("n > 0")


def _count(found: DataFrame, condition: Column | None = None) -> Column:
    """How many rows, or rows that meet a condition, of ``diffs`` or ``diff_groups``."""
    n = F.col("n") if "n" in found.columns else F.lit(1).cast("bigint")
    return F.sum(n if condition is None else F.when(condition, n).otherwise(0))


def diff_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("diff_type").agg(_count(found).alias("n"))


def diffs_by_label(left: Graph, right: Graph) -> DataFrame:
    """One row per label: the hashes of each side as sets; equal sets are `same`, two other sides `different`.

    Hashes are counted by label and hash, then by label, in the tasks first, so a label that many nodes have is never gathered.
    """

    def side(g: Graph, l: int, r: int) -> DataFrame:
        size = F.coalesce("closure_size", F.lit(0))
        return g.nodes.select("label", "drv_hash", F.lit(l).alias("l"), F.lit(r).alias("r"), (size * l).alias("l_closure"), (size * r).alias("r_closure"))

    each = side(left, 1, 0).unionByName(side(right, 0, 1))
    by_hash = each.groupBy("label", "drv_hash").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.sum("l_closure").alias("l_closure"), F.sum("r_closure").alias("r_closure"))
    counts = by_hash.groupBy("label").agg(
        F.max("l").alias("in_l"), F.max("r").alias("in_r"), F.count_if(F.col("drv_hash").isNotNull() & (F.col("l") != F.col("r"))).alias("apart"),
        F.count_if(F.col("drv_hash").isNotNull() & (F.col("l") == 1)).alias("l_variants"), F.count_if(F.col("drv_hash").isNotNull() & (F.col("r") == 1)).alias("r_variants"),
        F.sum("l_closure").alias("l_closure"), F.sum("r_closure").alias("r_closure"),
    )
    kind = F.when(F.col("in_l") == 0, "only_right").when(F.col("in_r") == 0, "only_left").when(F.col("apart") == 0, "same").otherwise("different")
    return counts.select("label", kind.alias("diff_type"), "l_variants", "r_variants", "l_closure", "r_closure")


def matched(left: Graph, right: Graph) -> DataFrame:
    """Nodes in pairs: by hash first, then the rest within a label by order of id; what is left stands alone."""
    numbered = lambda df, s: top_by(df, ["label"], [F.col("id")], 2**31 - 1).select("label", F.col("id").alias(f"{s}_id"), "rank")
    l, r = left.nodes.select("label", "id", "drv_hash"), right.nodes.select("label", "id", "drv_hash")
    same = l.select(F.col("id").alias("l_id"), "label", "drv_hash").join(r.select(F.col("id").alias("r_id"), "drv_hash"), "drv_hash")
    rest_l, rest_r = l.join(r.select("drv_hash"), "drv_hash", "left_anti"), r.join(l.select("drv_hash"), "drv_hash", "left_anti")
    pairs = numbered(rest_l, "l").join(numbered(rest_r, "r"), ["label", "rank"], "full_outer")
    kind = F.when(F.col("l_id").isNull(), "only_right").when(F.col("r_id").isNull(), "only_left").otherwise("different")
    return same.select("label", "l_id", "r_id", F.lit("same").alias("diff_type")).unionByName(pairs.select("label", "l_id", "r_id", kind.alias("diff_type")))


def closure_totals(left: Graph, right: Graph) -> DataFrame:
    """The totals of ``closure_comparison`` from counts of closure sizes by label: no pair is made.

    In the order of sizes within a label, a node of the right adds to each smaller one of the left, and the other way round. A
    label of one side alone meets one node of size 0 on the other, as does each node without a label.
    """
    sized = lambda g, s: g.nodes.select("label", F.lit(s).alias("side"), F.coalesce("closure_size", F.lit(0)).cast("decimal(38,0)").alias("size"))
    each = sized(left, "l").unionByName(sized(right, "r")).groupBy("label", "size").agg(*[F.count_if(F.col("side") == s).cast("decimal(19,0)").alias(f"{s}_n") for s in "lr"])
    named = each.where("label is not null")
    sides = named.groupBy("label").agg(F.sum("l_n").alias("l_all"), F.sum("r_n").alias("r_all"))
    missing = lambda s: F.when(F.col(f"{s}_all") == 0, 1).otherwise(0).cast("decimal(19,0)").alias(f"{s}_n")
    zeros = sides.where("l_all = 0 or r_all = 0").select("label", F.lit(0).cast("decimal(38,0)").alias("size"), missing("l"), missing("r"))
    whole = lambda c: c.cast("decimal(38,0)")
    up_to = Window.partitionBy("label").orderBy("size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    more = {}
    for s, other in (("r", "l"), ("l", "r")):
        n, total = F.sum(f"{other}_n").over(up_to), F.sum(whole(F.col("size") * F.col(f"{other}_n"))).over(up_to)
        more[s] = whole(whole(whole(F.col("size") * n) - total) * F.col(f"{s}_n"))
    rows = named.unionByName(zeros).select(more["r"].alias("added"), more["l"].alias("removed"))
    gain = lambda s, other: F.when(F.col("size") > 0, whole(F.col("size") * F.col(f"{s}_n"))).otherwise(whole(-F.col("size") * F.col(f"{other}_n")))
    rest = each.where("label is null").select(gain("r", "l").alias("added"), gain("l", "r").alias("removed"))
    return rows.unionByName(rest).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("added", "removed")])


def closure_comparison(found: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Added and removed closure in total, and the largest additions and removals."""
    totals = found.agg(F.sum(F.when(F.col("closure_impact") > 0, F.col("closure_impact")).otherwise(0)).alias("added"), F.sum(F.when(F.col("closure_impact") < 0, -F.col("closure_impact")).otherwise(0)).alias("removed"))
    only = found.where(F.col("diff_type").isin("only_left", "only_right")).withColumn("size", F.abs("closure_impact"))
    return totals, top_by(only, ["diff_type"], [F.col("size").desc(), F.col("label"), F.coalesce("l_id", "r_id")], limit).select("diff_type", "rank", "label", "size")


def categorised(found: DataFrame) -> DataFrame:
    return found if "category" in found.columns else found.withColumn("category", L.category(F.col("label"), F.col("package_type")))


def category_counts(found: DataFrame) -> DataFrame:
    return categorised(found).groupBy("category").agg(_count(found).alias("n"))


def label_category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(L.label_category(F.col("label")).alias("category")).agg(_count(found).alias("n"))


def category_summaries(found: DataFrame) -> DataFrame:
    """Per category, counts by kind of difference, the net change and the closure impact."""
    kind = F.col("diff_type")
    return categorised(found).groupBy("category").agg(
        _count(found, kind == "only_left").alias("left_only"), _count(found, kind == "only_right").alias("right_only"), _count(found, kind == "different").alias("different"), _count(found, kind == "same").alias("same"),
        (_count(found, kind == "only_right") - _count(found, kind == "only_left")).alias("net_change"), F.sum("closure_impact").alias("closure_impact"),
    )


def top_changes(found: DataFrame, limit: int = 10, *, by_label: bool = False) -> DataFrame:
    """The differences that matter most, by type and impact, or with labels and top-level packages as well."""
    group = F.col("label_category") if "label_category" in found.columns else L.label_category(F.col("label"))
    score = L.label_importance(group, F.col("package_type"), F.col("is_top_level"), F.col("closure_impact")) if by_label else L.importance(F.col("package_type"), F.col("closure_impact"))
    return found.where("diff_type <> 'same'").withColumn("score", F.round(score, 6)).orderBy(F.col("score").desc(), F.col("label").asc_nulls_last(), F.coalesce("l_id", "r_id").asc_nulls_last(), "r_id").limit(limit).select("label", "diff_type", "score", "closure_impact")


def top_changes_of(left: Graph, right: Graph, limit: int = 10, *, by_label: bool = False) -> DataFrame:
    """``top_changes`` over all differences of two imports, from the nodes alone that can be in them.

    Pairs of one label whose nodes agree in type, closure and mark have one score, so the order of ids settles which come first: of
    such nodes those are kept that are among the first ``limit`` of their hash, and of these the first ``2 * limit``. A pair with
    any other node has ``limit`` pairs before it, with nodes of its own hash or with kept ones of other hashes than the partner's.
    """
    parts = int(left.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first(df: DataFrame, s: str) -> DataFrame:
        df = df.repartition(parts, f"{s}_label").withColumns({"size": F.coalesce(f"{s}_closure", F.lit(0)), "none": F.col(f"{s}_id").isNull()})
        alike = [f"{s}_label", f"{s}_type", "size", f"{s}_top", "none"]
        of_hash = top_by(df, [*alike, f"{s}_hash"], [F.col(f"{s}_id")], limit)
        return top_by(of_hash, alike, [F.col(f"{s}_id")], 2 * limit).drop("size", "none", "rank")

    l, r = _sides(left, right)
    both = dealt_sides(first(l, "l"), first(r, "r"), many_copies(left, right), lambda df, s: df.withColumn(f"{s}_group", L.label_category(F.col(f"{s}_label"))), in_place=True)
    return top_changes(_rows(both, F.coalesce("l_group", "r_group").alias("label_category")), limit, by_label=by_label)


def version_changes(left: Graph, right: Graph, *, by_name: bool = True) -> DataFrame:
    """Changes of version between nodes that share a name (or, ``by_name=False``, a label); one row per pair."""

    def side(g: Graph, s: str) -> DataFrame:
        name, version = L.version_parts(F.col("label"))
        key = name if by_name else F.col("label")
        return g.nodes.select(key.alias("name"), version.alias(f"{s}_version"), F.col("drv_hash").alias(f"{s}_hash")).groupBy("name").agg(F.max_by(F.struct(f"{s}_version", f"{s}_hash"), F.struct(f"{s}_version", f"{s}_hash")).alias(s)).select("name", f"{s}.{s}_version", f"{s}.{s}_hash")

    both = side(left, "l").join(side(right, "r"), "name")
    return both.select("name", "l_version", "r_version", L.version_change(F.col("l_hash") == F.col("r_hash"), F.col("l_version"), F.col("r_version")).alias("change"))


def reverse_paths(graph: Graph, node_id: int, max_depth: int = 10, limit: int = 10) -> DataFrame:
    """Paths from a node up to what nothing needs, the longest first; depth counts nodes."""
    return _reverse_paths(graph, graph.nodes.where(F.col("id") == node_id).select(F.col("id").alias("seed")), max_depth, limit)


def _reverse_paths(graph: Graph, seeds: DataFrame, max_depth: int, limit: int) -> DataFrame:
    steps = upward(graph.deps).withColumn("kind", F.lit(""))
    paths = simple_paths(steps.distinct(), seeds, max_depth - 1).withColumn("head", F.element_at("path", -1))
    heads = graph.edges.select(F.col("source_id").alias("head")).distinct()
    kept = paths.join(heads, "head", "left_anti").select(F.size("path").cast("bigint").alias("n"), F.array_join(F.col("path").cast("array<string>"), "→").alias("path"))
    return kept.orderBy(F.col("n").desc(), "path").limit(limit)


def package_trace(left: Graph, right: Graph, label: str) -> DataFrame:
    """Whether both sides have a package, and with the same hash."""
    first = lambda g, s: g.nodes.where(F.col("label") == label).agg(F.min_by("drv_hash", "id").alias(s))
    return first(left, "l").crossJoin(first(right, "r")).select(F.lit(label).alias("label"), (F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same_hash"))


def package_trace_paths(left: Graph, right: Graph, label: str, max_depth: int = 10, limit: int = 10) -> DataFrame:
    """The paths that lead to a package on either side, the longest first; of nodes with one label the smallest id is taken."""
    sides = []
    for name, graph in (("left", left), ("right", right)):
        seeds = graph.nodes.where(F.col("label") == label).agg(F.min("id").alias("seed")).where("seed is not null")
        sides.append(_reverse_paths(graph, seeds, max_depth, limit).select(F.lit(name).alias("side"), "n", "path"))
    return sides[0].unionByName(sides[1])


def page(found: DataFrame, category: str, offset: int, limit: int) -> DataFrame:
    """A page of a category's differences by label."""
    return categorised(found).where((F.col("category") == category) & (F.col("diff_type") != "same")).orderBy(F.lower("label"), "label", F.coalesce("l_id", "r_id"), "r_id").offset(offset).limit(limit).select("label", "diff_type")


def page_of(left: Graph, right: Graph, groups: DataFrame, category: str, offset: int, limit: int) -> DataFrame:
    """``page`` from ``diff_groups``: pairs are made for the labels up to the page's end alone, as many as the page has rows at most."""
    end = offset + limit
    kept = categorised(groups).where((F.col("category") == category) & (F.col("diff_type") != "same"))
    order = [F.lower("label"), F.col("label")]
    first = kept.groupBy("label").agg(F.least(F.sum("n"), F.lit(end)).alias("n")).orderBy(*order).limit(end)
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as the page's end
    wanted = F.broadcast(first.select(F.col("label").alias("wanted"), before.alias("before")).where(F.col("before") < end).select("wanted"))
    some = lambda g: Graph(g.nodes.join(wanted, F.col("label").eqNullSafe(F.col("wanted")), "left_semi"), g.edges)
    return page(diffs(some(left), some(right)), category, offset, limit)


def csv_rows(found: DataFrame) -> DataFrame:
    """The rows of a CSV export: every difference but `same`."""
    return categorised(found).where("diff_type <> 'same'").select("label", "package_type", "category", "diff_type", "l_hash", "r_hash", "closure_impact")


def csv_export(found: DataFrame) -> DataFrame:
    """The full rows of a CSV export, every difference but `same`: versions, hashes, closures and flags of both sides."""
    of_label = F.col("version") if "version" in found.columns else L.version_parts(F.col("label"))[1]
    version = lambda s: F.when(F.col(f"{s}_id").isNotNull(), F.coalesce(of_label, F.lit(""))).otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flag = lambda s: F.when(F.col(f"{s}_top"), "true").otherwise("false")
    return categorised(found).where("diff_type <> 'same'").select(
        F.col("label").alias("package_label"), "diff_type", "category", text("package_type").alias("package_type"), version("l").alias("left_version"), version("r").alias("right_version"),
        text("l_hash").alias("left_drv_hash"), text("r_hash").alias("right_drv_hash"), text("l_closure").alias("left_closure_size"), text("r_closure").alias("right_closure_size"),
        "closure_impact", flag("l").alias("left_is_top_level"), flag("r").alias("right_is_top_level"),
    )


def json_report(found: DataFrame) -> DataFrame:
    """The report as one JSON object per kind of difference."""
    return found.groupBy("diff_type").agg(_count(found).alias("count"), F.sum("closure_impact").alias("impact")).select("diff_type", F.to_json(F.struct("diff_type", "count", "impact")).alias("json"))
