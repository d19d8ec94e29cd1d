"""What queries must not do as tables grow, and that the ways for large inputs give the same results."""

import random

import pytest

from graphloom.operators import compare, fixpoint, reachability, structure
from graphloom.plans import catalog
from graphloom.sources import graph as source


def reached(edges):
    following = {}
    for a, b in edges:
        following.setdefault(a, set()).add(b)
    found = {}
    for a in following:
        seen, left = set(), list(following[a])
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += following.get(x, ())
        found[a] = len(seen)
    return found


@pytest.mark.parametrize(("most", "wide"), [(1_024, 4_096), (2, 3)])
def test_closures_of_nodes_that_nothing_depends_on(spark, monkeypatch, most, wide):
    """Counted from lists of numbers, or by blocks where a set is large or edges are many; loops below them, and edges twice."""
    monkeypatch.setattr(reachability, "SMALL_SET", most)
    monkeypatch.setattr(reachability, "MANY_EDGES", wide)
    draw = random.Random(7)
    edges = [(draw.randrange(30), draw.randrange(30)) for _ in range(34)] + [(100 + i, draw.randrange(30)) for i in range(15) for _ in range(1 + i % 5)] + [(100, 3), (100, 3), (200, 201), (201, 201)]
    got = {r.id: r.closure_size for r in reachability.reached_counts(spark.createDataFrame(edges, "dependent bigint, dependency bigint")).collect()}
    assert got == reached(edges)


def test_stages_are_computed_for_those_who_ask(spark, small):
    """Depths need no closures, types and hashes need neither, and an import waits for its own stages alone."""
    c = catalog.Context(spark, small)
    assert c.depths.count() > 0 and c.computed.count() > 0
    assert not any(name == "closures" for name, _ in c._stages)
    c = catalog.Context(spark, small)
    assert c.s1.nodes.count() == c.g1.nodes.count()
    assert {i for _, i in c._stages} == {1}


def test_redundant_edges_leave_out_what_no_path_goes_through(spark, monkeypatch):
    """Of many packages over two nodes none can be bypassed, so no walk starts there; the one edge below that can be is found."""
    rows = [(1_000 + i, j) for i in range(200) for j in (1, 2)] + [(1, 3), (1, 4), (4, 3), (2, 4)]
    sizes = []
    monkeypatch.setattr(structure, "checkpointed", lambda df: sizes.append(out := fixpoint.checkpointed(df)) or out)
    found = structure.redundant_edges(source.from_edges(spark, rows, convention="B")).collect()
    assert [(r.dependent, r.dependency, r.bypass) for r in found] == [(1, 3, "1→4→3")]
    assert all(df.count() < 20 for df in sizes[4:])  # after the edges, what is inside, and the edges into and out of it


def test_differences_are_counted_without_pairs(spark):
    """Groups, pages and lone rows are those of the pairs, with null labels, types and hashes, and copies on both sides."""
    columns = "id bigint, label string, drv_hash string, package_type string, closure_size bigint, is_top_level boolean"
    draw = random.Random(3)
    pick = lambda *values: draw.choice(values)
    side = lambda at: source.Graph(spark.createDataFrame([(at + i, pick("a", "B", "b", "c", None, f"x{at}"), pick("h1", "h2", None), pick("library", "font", None), pick(1, 5, None), False) for i in range(60)], columns), None)
    left, right = side(0), side(1_000)
    pairs, groups = compare.diffs(left, right), compare.diff_groups(left, right)
    plain = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    for count in (compare.diff_counts, compare.category_counts, compare.label_category_counts, compare.category_summaries, compare.json_report):
        assert plain(count(groups)) == plain(count(pairs))
    assert plain(compare.lone_diffs(left, right)) == plain(pairs.where("diff_type like 'only%'"))
    for offset in (0, 3, 50, 400):
        assert compare.page_of(left, right, groups, "Other", offset, 20).collect() == compare.page(pairs, "Other", offset, 20).collect()


def test_many_copies_of_a_label_on_both_sides(spark):
    """Four million pairs of one label are one group."""
    nodes = lambda at: source.Graph(spark.range(at, at + 2_000).selectExpr("id", "'same' as label", "cast(id as string) as drv_hash", "'font' as package_type", "3L as closure_size", "false as is_top_level"), None)
    assert [tuple(r) for r in compare.diff_groups(nodes(0), nodes(1_000)).orderBy("diff_type").collect()] == [("same", "font", "different", 3_999_000, 0), ("same", "font", "same", 1_000, 0)]


def test_variants_by_hash_wait_for_no_stage(spark, small, monkeypatch):
    monkeypatch.setattr(catalog, "_contexts", {})
    assert catalog.queries()["variants_by_hash"](spark, small).count() > 0
    assert not catalog.context(spark, small)._stages
