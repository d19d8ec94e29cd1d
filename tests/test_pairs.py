"""Comparisons of all pairs of a label that store none of them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import compare, reports
from graphloom.plans import catalog
from graphloom.sources.graph import Graph

COLUMNS = "id bigint, label string, drv_hash string, package_type string, closure_size bigint, is_top_level boolean, depth bigint"


def two_sides(spark, n=60):
    """Copies of labels and hashes on both sides, nulls everywhere, labels of one side and nodes without an id."""
    draw = random.Random(17)
    pick = lambda *values: draw.choice(values)
    row = lambda i, at: (i, pick("gcc-12.1", "gnome-a", "b", "b", None, f"x{at}"), pick("h1", "h1", "h2", None), pick("library", "application", None), pick(1, 5, 700, 1_400, None), pick(True, False, None), pick(2, None))
    side = lambda at: Graph(spark.createDataFrame([row(at + i, at) for i in range(n)] + [(None, "b", "h1", None, 7, True, None)] * 2, COLUMNS), None)
    return side(0), side(1_000)


def plain(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("copies", [1_024, 4])
def test_rows_of_all_pairs(spark, monkeypatch, copies):
    """Those of the join, where labels have few copies and where they are dealt to units, and a side without nodes."""
    monkeypatch.setattr(compare, "UNIT_COPIES", copies)
    left, right = two_sides(spark)
    for l, r in ((left, right), (left, Graph(right.nodes.where("false"), None))):
        found, wanted = compare.dealt_diffs(l, r), compare.diffs(l, r)
        assert plain(found.drop("category", "version")) == plain(wanted)
        assert plain(compare.csv_rows(found)) == plain(compare.csv_rows(wanted))
        assert plain(compare.csv_export(found)) == plain(compare.csv_export(wanted))


def test_closures_are_compared_without_pairs(spark):
    left, right = two_sides(spark)
    none = Graph(right.nodes.where("false"), None)
    below = Graph(right.nodes.withColumn("closure_size", F.col("closure_size") - 600), None)
    for l, r in ((left, right), (right, left), (left, none), (none, left), (none, none), (below, left)):
        assert plain(compare.closure_totals(l, r)) == plain(compare.closure_comparison(compare.diffs(l, r))[0])
    many = lambda size: Graph(spark.range(200_000).selectExpr("id", "'same' as label", "cast(id as string) as drv_hash", "'font' as package_type", f"{size} as closure_size", "false as is_top_level"), None)
    assert [tuple(r) for r in compare.closure_totals(many("3L"), many("5L")).collect()] == [(80_000_000_000, 0)]


@pytest.mark.parametrize("limit", [1, 2, 10])
def test_top_changes_come_from_few_nodes(spark, monkeypatch, limit):
    """The first of all pairs in order, null labels last; of copies only so many are paired."""
    left, right = two_sides(spark, 150)
    for by_label in (False, True):
        wanted = compare.top_changes(compare.diffs(left, right), limit, by_label=by_label).collect()
        assert compare.top_changes_of(left, right, limit, by_label=by_label).collect() == wanted
    same = lambda at: Graph(spark.range(at, at + 3_000).selectExpr("id", "'same' as label", "cast(id % 2000 as string) as drv_hash", "'font' as package_type", "3L as closure_size", "false as is_top_level"), None)
    pairs = []
    monkeypatch.setattr(compare, "top_changes", lambda found, *a, plain=compare.top_changes, **k: pairs.append(found.count()) or plain(found, *a, **k))
    assert {tuple(r) for r in compare.top_changes_of(same(0), same(1_000), limit).collect()} == {("same", "different", 2.0, 0)} and pairs[0] <= 4 * limit**2


def test_null_labels_come_last(spark):
    one = Graph(spark.createDataFrame([(1, None, "h", "font", 5, False, None), (2, "b", "h", "font", 5, False, None)], COLUMNS), None)
    assert [r.label for r in compare.top_changes(compare.diffs(one, Graph(one.nodes.where("false"), None))).collect()] == ["b", None]


@pytest.mark.parametrize("copies", [1_024, 4])
def test_entries_of_nodes_without_ids(spark, monkeypatch, copies):
    """A pair with a node that has no id is of one side, as in the SQL; nodes are shuffled by their columns, not by texts."""
    monkeypatch.setattr(compare, "UNIT_COPIES", copies)
    left, right = two_sides(spark)
    found = reports.all_entries(left, right)
    assert plain(found) == plain(reports.entries(compare.diffs(left, right)))
    shuffles = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in line]
    assert shuffles and not any("head" in line for line in shuffles)


def test_numbered_json_puts_nodes_of_different_pairs_alone_in_order(spark, monkeypatch):
    """Of a thousand labels one has different hashes."""
    nodes = lambda at, other: Graph(spark.range(at, at + 1_000).selectExpr("id", f"concat('x', id - {at}) as label", f"if(id = {at + 7}, '{other}', 'h') as drv_hash", "'font' as package_type", "3L as closure_size", "false as is_top_level"), None)
    given = []
    monkeypatch.setattr(reports, "counted_sides", lambda l, r, plain=reports.counted_sides: given.extend((l.count(), r.count())) or plain(l, r))
    side = spark.createDataFrame([(1, "host", "base", None, 1)], "id bigint, name string, config_path string, imported_at timestamp_ntz, node_count bigint")
    lines = reports.numbered_json(nodes(0, "a"), nodes(5_000, "b"), side, side, "now").orderBy("number").collect()
    assert given == [1, 1] and [json.loads(r.line)["left_node"]["id"] for r in lines if '"left_node"' in r.line] == [7]


def test_queries_on_pairs_store_none(spark, small, monkeypatch):
    """What is stored of a comparison are labels of many copies."""
    made = []
    c = catalog.Context(spark, small)
    assert c.s1 is not None and c.s2 is not None
    monkeypatch.setattr(compare, "stored", lambda df, plain=compare.stored: made.append(df) or plain(df))
    monkeypatch.setattr(catalog, "checkpointed", lambda df: 1 / 0)
    assert c.diffs.count() > 1_000 and [df.columns for df in made] == [["many_label", "l_n", "r_n"]]
