"""Graph operators on small known graphs and against plain Python on random ones."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom.operators import browse, compare, contribution, drawing, importing, structure, treemap, variants, why
from graphloom.operators.fixpoint import closure_pairs, strong_components
from graphloom.sources.graph import from_edges


def closure_of(edges):
    """edges: (dependent, dependency)"""
    found = {}
    for start in {a for a, _ in edges}:
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        found[start] = seen
    return found


@pytest.mark.parametrize("edges,sizes", [([(1, 2), (2, 1)], [2]), ([(1, 2), (1, 3), (2, 3)], []), ([(1, 2), (2, 1), (3, 4), (4, 3)], [2, 2]), ([(1, 2), (2, 3), (3, 1)], [3]), ([(1, 1), (1, 2)], [])])
def test_loops(spark, edges, sizes):
    g = from_edges(spark, edges)
    counts = structure.loops(g).groupBy("scc_id").count().collect()
    assert sorted(r["count"] for r in counts) == sorted(sizes)


def test_loop_paths(spark):
    rows = structure.loop_paths(from_edges(spark, [(1, 2), (2, 3), (3, 1), (2, 1), (5, 1)])).collect()
    assert [(r.scc_id, r["size"], r.cycle_length) for r in rows] == [(1, 3, 2)]


@pytest.mark.parametrize("edges,found", [([(1, 2), (2, 3), (1, 3)], {(1, 3)}), ([(1, 2), (1, 3)], set())])
def test_redundant(spark, edges, found):
    rows = structure.redundant_edges(from_edges(spark, edges, convention="B")).collect()
    assert {(r.dependent, r.dependency) for r in rows} == found
    assert all(r.bypass == "1→2→3" for r in rows)


PATHS = [
    ([(1, 2), (2, 3)], (1,), 3, 10, ["1→2→3"]), ([(1, 3), (2, 3), (3, 4)], (1, 2), 4, 10, ["1→3→4", "2→3→4"]), ([(1, 2), (2, 3), (3, 4), (4, 5)], (1,), 5, 2, []),
    ([(1, 2)], (2,), 2, 10, ["2"]), ([(1, 2), (2, 3), (3, 2)], (1,), 3, 10, ["1→2→3"]),
]


@pytest.mark.parametrize("edges,top,target,depth,want", PATHS)
def test_attribution_paths(spark, edges, top, target, depth, want):
    g = from_edges(spark, edges, top, convention="B")
    assert sorted(r.path for r in why.written(why.attribution_paths(g, target, depth)).collect()) == want


def test_direction_does_not_matter_once_loaded(spark):
    a, b = from_edges(spark, [(2, 1), (3, 2)], (1,)), from_edges(spark, [(1, 2), (2, 3)], (1,), convention="B")
    assert sorted(map(tuple, a.deps.collect())) == sorted(map(tuple, b.deps.collect()))


def test_essentiality(spark):
    g = from_edges(spark, [(1, 3), (2, 3), (4, 5)], (1, 2), convention="B", kinds={(1, 3): "build"})
    got = why.essentiality(why.attribution_paths(g, 3)).first()
    assert (got.status, got.runtime_dependents, got.build_dependents, got.is_direct) == ("essential_single", 1, 1, True)
    assert why.essentiality(why.attribution_paths(g, 5)).first().status == "orphan"


def test_contributions(spark):
    # closures {10, 11, 12} and {11, 12, 13}
    g = from_edges(spark, [(1, 10), (1, 11), (11, 12), (2, 11), (2, 13)], (1, 2), convention="B")
    rows = {r.id: tuple(r)[1:] for r in contribution.contributions(g).collect()}
    assert rows == {1: (1, 2, 3), 2: (1, 2, 3)}


def test_leaves_have_no_closure_size_and_cycles_end(spark):
    g = from_edges(spark, [(1, 2), (2, 1), (2, 3)], convention="B")
    assert {r.id: r.closure_size for r in importing.closure_sizes(g).collect()} == {1: 3, 2: 3}
    assert importing.depths(g).count() <= 3


def test_right_only_differences(spark):
    left, right = from_edges(spark, [(1, 2)]), from_edges(spark, [(2, 3)])
    assert {r.label: r.diff_type for r in compare.diffs(left, right).collect()} == {"n1": "only_left", "n2": "same", "n3": "only_right"}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = sorted({(draw.randrange(14), draw.randrange(14)) for _ in range(26)})
    edges = [(a, b) for a, b in edges if a != b]
    g, want = from_edges(spark, edges, convention="B"), closure_of(edges)
    assert {(r.node, r.dep) for r in closure_pairs(g.deps).collect()} == {(a, b) for a, found in want.items() for b in found}
    same = {a: min([x for x in want[a] if a in want.get(x, ())], default=None) for a in want if a in want[a]}
    assert {r.id: r.scc_id for r in strong_components(g.deps).collect()} == same
    node = edges[0][0]
    assert browse.impact(g, node).agg(F.sum("packages")).first()[0] == len(want[node])


def test_dot_round_trip(spark):
    a, b = "a" * 32, "b" * 32
    lines = [f'"{a}-foo-1.drv" [label = "foo-1.drv", x];', f'"{b}-bar" [label = "bar"];', f'"{a}-foo-1.drv" [label = "foo-2.drv"];', f'"{a}-foo-1.drv" -> "{b}-bar" [color = "red"];', f'"{a}-foo-1.drv" -> "{b}-bar" [color = "blue"];', f'"{a}-foo-1.drv" -> "{"c" * 32}-none";', "}"]
    nodes, edges = importing.parse_dot(spark.createDataFrame(list(enumerate(lines)), "line bigint, value string"))
    assert {tuple(r) for r in nodes.collect()} == {(a, "foo-1.drv", "foo-2"), (b, "bar", "bar")}
    assert [tuple(r) for r in edges.collect()] == [(a, b, "red")]


def test_sankey_has_all_variants_and_paths(spark):
    # 12 variants; the first is needed by 150 top-level packages through one node, each other by one of its own
    edges = [(1000 + i, 500) for i in range(150)] + [(500, 1)] + [(2000 + i, i) for i in range(2, 13)]
    g = from_edges(spark, edges, convention="B")
    name = F.when(F.col("id") <= 12, "lib").otherwise(F.col("id").cast("string"))
    g = replace(g, nodes=g.nodes.withColumn("label", name).withColumn("is_top_level", F.col("id") >= 1000))
    found = {(r.source, r.target): r.value for r in why.sankey(g, "lib").collect()}
    assert found == {(500, 1): 150} | {(1000 + i, 500): 1 for i in range(150)} | {(2000 + i, i): 1 for i in range(2, 13)}


def test_sentences_count_each_package_once(spark):
    """Two top-level packages over two middle nodes; one alone; one that needs the target directly."""

    def said(edges, top, target, label):
        graph = from_edges(spark, edges, top, "B")
        paths = why.attribution_paths(graph, target)
        return why.summary_text(why.path_groups(graph, paths, None), paths, label).first().summary, why.removal_impact(graph, target, paths).first().summary

    assert said([(1, 3), (1, 4), (2, 3), (2, 4), (3, 5), (4, 5)], (1, 2), 5, "n5") == ("n5 is needed by 2 top-level packages: via n3 (2), via n4 (2)", "Would break 2 packages.")
    assert said([(1, 3), (3, 5)], (1,), 5, "n5") == ("n5 is needed by n1", "Would break n1.")
    assert said([(1, 5), (2, 3), (3, 5)], (1, 2), 5, "n5")[0] == "n5 is needed by 2 top-level packages: directly by n1, via n3"
    assert said([(1, 3)], (1,), 9, "n9")[0] == "n9 is not required by any top-level package"


def test_removal_counts_all_that_goes(spark):
    """A chain of 30 and 60 other dependencies below a node that nothing else needs: more than a list shows, deeper than a listing walks."""
    edges = [(10, 11 + i) for i in range(60)] + [(10 if i == 0 else 99 + i, 100 + i) for i in range(30)] + [(1, 10)]
    graph = from_edges(spark, edges, (1,), "B")
    assert why.removal_impact(graph, 10, why.attribution_paths(graph, 10)).first().closure_reduction == 91
    assert why.unique_dependencies(graph, 10).count() == 50


def test_a_loop_has_its_cycle(spark):
    rows = structure.loop_paths(from_edges(spark, [(1, 2), (2, 3), (3, 1), (2, 1), (4, 5), (5, 6), (6, 4), (3, 4)], (), "B")).orderBy("scc_id").collect()
    assert [(r.scc_id, r["size"], r.cycle_length, r.cycle) for r in rows] == [(1, 3, 2, "1→2→1"), (4, 3, 3, "4→5→6→4")]


#: Two variants of one label below three packages: 1 directly, 2 and 3 over 10.
FLOW = [(1, 20), (2, 10), (3, 10), (10, 20), (3, 21)]


def flow(spark):
    g = from_edges(spark, FLOW, (1, 2, 3), convention="B")
    return replace(g, nodes=g.nodes.withColumn("label", F.when(F.col("id") >= 20, "lib").otherwise(F.col("label"))))


@pytest.mark.parametrize("limits,want", [
    ({}, {(1, 20, 1), (10, 20, 2), (2, 10, 1), (3, 10, 1), (3, 21, 1)}), ({"max_intermediate": 1}, {(10, 20, 2), (2, 10, 1), (3, 10, 1), (3, 21, 1)}),
    ({"max_top_level": 1}, {(1, 20, 1), (10, 20, 2), (2, 10, 1), (3, 21, 1)}), ({"app": "n3"}, {(10, 20, 1), (3, 10, 1), (3, 21, 1)}), ({"app": "none"}, set()),
])
def test_sankey_limits(spark, limits, want):
    assert {tuple(r) for r in why.sankey(flow(spark), "lib", **limits).collect()} == want


def test_variant_order(spark):
    g = flow(spark)
    order = lambda by, **more: [(r.id, r.dependents) for r in variants.variant_order(g, "lib", by, **more).orderBy("rank").collect()]
    assert order("hash") == order("dependent_count") == [(20, 2), (21, 1)]
    assert order("dependent_count", kind="build") == [(20, 0), (21, 0)]
    assert order("closure_size", max_variants=1) == [(20, 2)]


def test_treemap_filters(spark):
    g = from_edges(spark, [(1, 2), (1, 3)], (1,), convention="B", kinds={(1, 3): "build"})
    below = lambda kind: {r.id for r in treemap.treemap(g, filter_type=kind, root=1, levels=1).where("level = 1").collect()}
    assert below("all") == {2, 3} and below("runtime") == {2} and below("build") == {3} and below("type:font") == set()
    assert [(r.label, r.value) for r in treemap.treemap(g, root=99).collect()] == [("Not Found", 0)]


def test_drawings(spark):
    g = from_edges(spark, [(1, 2), (2, 3)], convention="B")
    g = replace(g, nodes=g.nodes.withColumn("label", F.when(F.col("id") == 1, 'a"b\\').otherwise(F.col("label"))))
    lines = {tuple(r) for r in drawing.node_drawing(g, 2).collect()}
    assert ("dependents", 'n1 [label="a\\"b\\\\", fillcolor="#22d3ee"];') in lines
    assert {s for p, s in lines if p == "edges"} == {"n1 -> n2;", "n2 -> n3;"}
    assert drawing.cluster_drawing(g).count() == 1


def test_why_chain_without_paths(spark):
    g = from_edges(spark, [(1, 2)], convention="B")
    paths = why.attribution_paths(g, 2, max_paths=None)
    row = why.why_chain(g, 2, paths).first()
    assert (row.total_paths_found, row.direct_dependents, row.essentiality, row.via) == (0, 1, "orphan", "")
    only = why.attribution_export(g, 2, paths).collect()
    assert [(r.via_package, r.group_dependent_count, r.is_runtime_path) for r in only] == [("(no attribution paths)", 0, "")]
