"""Closures as sets, users of nodes, contributions under change, stored results and the stream of changes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import reachability, structure
from graphloom.operators.usage import Kept, contributions_of, states
from graphloom.sources.graph import from_edges
from graphloom.sources.results import ResultStore
from graphloom.streaming.changes import StoredGraph, apply_changes


def plain_closures(edges):
    below, found = {}, {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    for a in below:
        seen, stack = set(), list(below[a])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += below.get(x, ())
        found[a] = seen
    return found


def plain_contributions(edges, tops):
    found = {t: c for t, c in plain_closures(edges).items() if t in tops}
    unique = {t: sum(all(d not in c for o, c in found.items() if o != t) for d in below) for t, below in found.items()}
    return sorted((t, unique[t], len(c) - unique[t], len(c)) for t, c in found.items())


def rows(kept):
    return sorted(tuple(r) for r in kept.contributions.select("id", "unique_contribution", "shared_contribution", "total_contribution").collect())


def graph(spark, edges, tops):
    return from_edges(spark, sorted(edges), tuple(sorted(tops)), convention="B")


def test_sets_of_a_block():
    rng = np.random.default_rng(1)
    few, many = np.unique(rng.integers(0, 1 << 16, 300)), np.unique(rng.integers(0, 1 << 16, 9_000))
    for offsets in (few, many, np.arange(reachability.DENSE), np.arange(reachability.DENSE - 1), np.arange(1 << 16)):
        assert (reachability.decoded(reachability.encoded(offsets)) == offsets).all() and len(reachability.encoded(offsets)) <= 8_192
    near = np.unique(rng.integers(0, 1 << 16, 3_900))
    groups = {(7, 0): [few, many], (7, 1): [few], (2, 5): [few, near, few], (3, 0): [many, many]}
    keys = [(k, reachability.encoded(s)) for k, sets in groups.items() for s in sets]
    rng.shuffle(keys)
    ids, blocks, members = reachability.united(np.array([k[0][0] for k in keys]), np.array([k[0][1] for k in keys]), [k[1] for k in keys])
    assert list(zip(ids, blocks)) == sorted(groups)
    for i, b, m in zip(ids, blocks, members):
        assert (reachability.decoded(m) == np.unique(np.concatenate(groups[i, b]))).all()


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (1, 3)],
        [(1, 2), (2, 1), (1, 3), (4, 1), (3, 3)],  # a loop on a leaf that depends on itself
        [(1, 2), (2, 1)],
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 8)],  # a loop above a loop
        [(1, 1)],
        [(1, 2), (2, 1), (3, 1), (4, 3), (5, 6), (6, 5), (5, 4), (7, 8)],  # loops that depend on nothing, under other nodes
        [(i, i + 1) for i in range(12)],
        [(random.Random(4).randrange(40) * k % 37, k % 23) for k in range(60)],
    ],
)
def test_closure_sizes(spark, edges):
    got = dict(tuple(r) for r in reachability.reached_counts(spark.createDataFrame(edges, "dependent bigint, dependency bigint")).collect())
    assert got == {a: len(c) for a, c in plain_closures(edges).items()}


def test_closure_sizes_of_nothing(spark):
    assert reachability.reached_counts(spark.createDataFrame([(None, 1), (2, None)], "dependent bigint, dependency bigint")).count() == 0


def test_closure_sizes_over_blocks(spark, monkeypatch):
    """Targets of several blocks, bitmaps among them; rows are of nodes and blocks, not of pairs."""
    monkeypatch.setattr(reachability, "BLOCK_BITS", 16)
    wide = spark.range(0, 140_000).select(F.lit(-1).alias("dependent"), F.col("id").alias("dependency"))
    more = spark.range(0, 9_000).select(F.lit(-2).alias("dependent"), F.col("id").alias("dependency")).unionByName(spark.sql("select -3 as dependent, -1 as dependency"))
    deps = wide.unionByName(more).select(F.col("dependent").cast("bigint"), F.col("dependency").cast("bigint"))
    got = dict(tuple(r) for r in reachability.reached_counts(deps).collect())
    assert got == {-1: 140_000, -2: 9_000, -3: 140_001}


def test_dense_numbers(spark):
    got = reachability.dense_numbers(spark.range(0, 3_000, 3)).collect()
    assert sorted((r.id, r.number) for r in got) == [(3 * k, k) for k in range(1_000)]


def test_states_of_users(spark):
    g = graph(spark, [(1, 10), (2, 10), (1, 11), (11, 12), (12, 11), (2, 13), (13, 14), (1, 2), (20, 21)], [1, 2])
    assert sorted(tuple(r) for r in states(g).collect()) == [(2, 1, False), (10, None, True), (11, 1, False), (12, 1, False), (13, None, True), (14, None, True)]


def test_contributions_after_random_changes(spark):
    rng = random.Random(11)
    edges, tops = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}, {0, 3, 5, 7}
    g = graph(spark, edges, tops)
    kept = Kept.of(g)
    assert rows(kept) == plain_contributions(edges, tops)
    for _ in range(4):
        now, marked = set(edges), set(tops)
        for _ in range(rng.choice([1, 2, 3])):
            draw = rng.random()
            if draw < 0.4:
                now.discard(rng.choice(sorted(now)))
            elif draw < 0.8:
                now.add((rng.randrange(14), rng.randrange(14)))
            else:
                marked ^= {rng.randrange(14)}
        after = graph(spark, now, marked)
        kept, _ = kept.changed(g, after)
        assert rows(kept) == plain_contributions(now, marked)
        some = spark.createDataFrame([(t,) for t in sorted(marked)[:2]], "id bigint")
        assert sorted(tuple(r) for r in contributions_of(after, kept.states, some).collect()) == [r for r in plain_contributions(now, marked) if r[0] in sorted(marked)[:2]]
        g, edges, tops = after, now, marked


def test_one_changed_edge_walks_its_cone_only(spark):
    # three hundred packages with ten dependencies each, and one edge less
    edges = {(t, 1_000 + 10 * t + k) for t in range(300) for k in range(10)} | {(1_000, 9_000), (9_000, 9_001)}
    before, after = graph(spark, edges, range(300)), graph(spark, edges - {(1_000, 9_000)}, range(300))
    kept, walked = Kept.of(before).changed(before, after)
    assert sorted(r.id for r in walked["states"].collect()) == [9_000, 9_001]
    assert [r.id for r in walked["packages"].collect()] == [0]
    assert rows(kept) == plain_contributions(edges - {(1_000, 9_000)}, range(300))


def plain_bypasses(edges, most):
    """By all simple paths: the shortest other path of each edge, of equals the one of smallest nodes."""
    below, found = {}, {}
    for a, b in edges:
        if a != b:
            below.setdefault(a, set()).add(b)

    def walk(path):
        for x in sorted(below.get(path[-1], ())):
            if x not in path and len(path) <= most:
                longer = [*path, x]
                if len(longer) > 2 and x in below[path[0]]:
                    best = found.get((path[0], x))
                    if best is None or (len(longer), longer) < (len(best), best):
                        found[path[0], x] = longer
                walk(longer)

    for a in below:
        walk([a])
    return sorted((a, c, len(p) - 1, "→".join(map(str, p))) for (a, c), p in found.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_redundant_edges(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(11), rng.randrange(11)) for _ in range(rng.choice([14, 22, 30]))}
    got = structure.redundant_edges(graph(spark, edges, []), None).select("dependent", "dependency", "bypass_length", "bypass").collect()
    assert sorted(map(tuple, got)) == plain_bypasses(edges, 5)


NOW, LATER, LATE = "2024-01-01 00:00:00", "2024-01-01 00:15:00", "2024-01-01 01:30:00"


def entries(store, now, import_id=1, kind="why"):
    return sorted((r.key, r.n) for r in store.get(import_id, kind, now, "n bigint").collect())


def numbers(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, n bigint")


def test_stored_results(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"))
    assert entries(store, NOW) == [] and store.places() == [] and store.cleanup(NOW) == 0 and store.stats().count() == 0
    store.put(1, "why", numbers(spark, ("a", 1), ("a", 2), ("b", 3), (None, None)), NOW, "short")
    store.put(1, "why", numbers(spark, ("c", 4)), NOW, "common")
    store.put(2, "why", numbers(spark, ("a", 9)), NOW)
    store.put(1, "why", numbers(spark, ("a", 5)), NOW)
    key = lambda pairs: sorted(pairs, key=str)
    got = [(r.key, r.n) for r in store.get(1, "why", NOW, "n bigint").collect()]
    assert key(got) == key([(None, None), ("a", 5), ("b", 3), ("c", 4)])
    assert entries(store, LATER) == [("a", 5), ("c", 4)]
    assert entries(store, LATE) == [("c", 4)] and entries(store, LATE, 2) == []
    assert {(r.import_id, r.kind, r.entries) for r in store.stats().collect()} == {(1, "why", 3), (2, "why", 1)}
    assert store.cleanup(LATER) == 2 and store.cleanup(LATE) == 2 and store.places() == [(1, "why")]
    assert store.invalidate(1, "other") == 0 and store.invalidate(1) == 1 and entries(store, NOW) == []


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"))
    store.put(1, "why", numbers(spark, ("a", 1), ("b", 2)), NOW)
    broken = spark.range(0, 50, numPartitions=4).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="lost"):
        store.put(1, "why", broken, NOW)
    assert entries(store, NOW) == [("a", 1), ("b", 2)]
    # files of a version whose last step is missing are there, but not read; the next version passes it by
    (tmp_path / "r/import_id=1/kind=why/v=000000000007").mkdir()
    numbers(spark, ("z", 1)).write.parquet(str(tmp_path / "r/import_id=1/kind=why/v=000000000007/part"))
    assert entries(store, NOW) == [("a", 1), ("b", 2)]
    store.put(1, "why", numbers(spark, ("b", 3)), NOW)
    assert entries(store, NOW) == [("a", 1), ("b", 3)] and store.folder.names("import_id=1/kind=why")[-1] == "v=000000000008"
    store.cleanup(NOW)
    assert "v=000000000007" not in store.folder.names("import_id=1/kind=why")


def test_get_or_compute(spark, tmp_path):
    store, calls = ResultStore(spark, str(tmp_path / "r")), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "n bigint")

    ask = lambda now: [r.n for r in store.get_or_compute(1, "why", "k", now, "n bigint", compute, "short").collect()]
    assert (ask(NOW), ask(NOW), ask(LATER), ask(LATER)) == ([1], [1], [2], [2])


CHANGES = "sequence bigint, action string, dependent bigint, dependency bigint, dep_type string"


def test_stream_of_changes(spark, tmp_path):
    """Changes in and out of order, twice, and a batch that is done again, give the graph of each edge's last change."""
    edges = {(1, 10), (2, 11), (11, 12), (1, 12)}
    g = graph(spark, edges | {(3, 3)}, [1, 2])
    stored = StoredGraph(g.nodes, str(tmp_path / "store"))
    assert stored.latest() is None
    stored.start(g)
    batches = [
        [(5, "remove", 1, 10, None), (6, "add", 2, 12, "build"), (None, "add", 1, 1, None), (7, "what", 1, 2, None)],
        [(4, "add", 1, 10, "runtime"), (8, "add", 12, 3, "runtime"), (8, "add", 12, 3, "runtime"), (6, "add", 2, 12, "build")],  # the first is late
        [(9, "remove", 12, 3, None), (10, "add", 10, 11, None), (10, "add", 1, 10, None)],
    ]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        apply_changes(stream, stored, str(tmp_path / "state")).awaitTermination(200)
    want = (edges | {(3, 3), (2, 12), (1, 10), (10, 11)})
    last = stored.latest()
    assert last == 3 and {(r.dependent, r.dependency) for r in stored.graph(last).deps.collect()} == want
    assert rows(stored.kept(last)) == plain_contributions(want, {1, 2})
    # the last batch again, from the version before it
    stored.apply(spark.createDataFrame(batches[2], CHANGES), 2)
    assert stored.latest() == 3 and rows(stored.kept(3)) == plain_contributions(want, {1, 2})
