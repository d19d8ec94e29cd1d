"""Bounds on what queries over one import store and read."""

from graphloom.operators import browse, usage
from graphloom.plans import catalog
from graphloom.sources import graph as source
from graphloom.sources import label_index


def test_a_query_over_one_import_stores_no_other(spark, small):
    """Imports lie in Parquet, so that a task reads the columns it needs of a part of a file."""
    c = catalog.Context(spark, small)
    assert c.g1.nodes.count() > 0 and c.label and c.paths is not None
    assert set(c._imports) == {1}
    assert all(f.endswith(".parquet") for f in c.g1.edges.inputFiles()) and c.g1.edges.inputFiles()
    whole = source.from_tables(spark, small)
    assert c.raw.nodes.exceptAll(whole.nodes).isEmpty() and whole.nodes.exceptAll(c.raw.nodes).isEmpty()
    assert c.raw.edges.exceptAll(whole.edges).isEmpty() and whole.edges.exceptAll(c.raw.edges).isEmpty()


def test_lists_are_dealt_by_how_many_labels_there_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(label_index, "DEALT_LABELS", 5)
    nodes = spark.range(200).selectExpr("1L as import_id", "id", "case when id = 7 then null when id = 8 then '--' else concat('Order-', id) end as label")
    plain = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        index = label_index.LabelIndex(spark, str(tmp_path)).write(nodes)
    finally:
        for k, v in plain.items():
            spark.conf.set(k, v)
    of_one_bucket = index.lists.where("gram = 'ord'")
    assert of_one_bucket.count() == 198 and len(of_one_bucket.select("_metadata.file_path").distinct().collect()) > 4


def test_similarity_of_defined_packages_is_counted_from_shared_trigrams(spark, monkeypatch):
    """None is computed for a pair: a fallback that made trigrams of each candidate anew is gone, and the results are its results."""
    assert not hasattr(browse, "trigrams")
    labels = ["git", "git-lfs", "gitolite", "vim", "Vim-full", None, "--", "firefox-esr"]
    nodes = spark.createDataFrame([(i, label) for i, label in enumerate(labels)], "id bigint, label string")
    names = spark.createDataFrame([("git",), ("git-lfs",), ("firefox-esr",), ("nothing",), ("git",), (None,)], "name string")
    monkeypatch.setattr(browse, "similarity", None)
    found = {r.name: r.id for r in browse.defined_packages(source.Graph(nodes, None), names).collect()}
    assert found == {"git": 0, "git-lfs": 0, "firefox-esr": 7, "nothing": None, None: None}


def test_candidates_of_defined_packages_are_in_no_join_of_their_own(spark):
    """Most nodes may be candidates, which a join by their ids would bring to the driver: they meet the names alone. Repeated ids are nodes apart."""
    nodes = spark.createDataFrame([(i % 40, f"order-{i}") for i in range(60)], "id bigint, label string")
    found = browse.defined_packages(source.Graph(nodes, None), spark.createDataFrame([("order-7",)], "name string"))
    assert [tuple(r) for r in found.collect()] == [("order-7", None, None)]  # `order-0` to `order-4` come before it
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_changed_edges_are_found_in_one_pass(spark, monkeypatch):
    """Edges of both graphs meet once, doubles and types aside; the difference takes no EXCEPT ALL, which repeats rows."""
    before = source.from_edges(spark, [(2, 1), (3, 2), (3, 2), (4, 3)], top=(4, 5), convention="B")
    after = source.from_edges(spark, [(2, 1), (3, 2), (5, 3), (5, 1)], top=(4, 5), convention="B")
    kept = usage.Kept.of(before)
    monkeypatch.setattr(type(before.nodes), "exceptAll", lambda a, b, plain=type(before.nodes).exceptAll: plain(a, b) if a.columns == ["id"] else 1 / 0)
    found = {r.id: r.total_contribution for r in kept.changed(before, after)[0].contributions.collect()}
    assert found == {5: 3}


def test_rounds_go_over_the_edges_below_packages(spark, monkeypatch):
    """Of 200 nodes that nothing depends on one is a package: states and closures are made from its edges and those below, stored once."""
    rows = [(1_000 + i, j) for i in range(200) for j in (1, 2)] + [(1, 3), (3, 4), (1, 3), (1_000, 3)]
    given = []
    monkeypatch.setattr(usage, "spread", lambda edges, *more, plain=usage.spread: given.append(edges) or plain(edges, *more))
    monkeypatch.setattr(usage, "reached_counts", lambda edges, plain=usage.reached_counts: given.append(edges) or plain(edges))
    kept = usage.Kept.of(source.from_edges(spark, rows, top=(1_000,), convention="B"))
    assert [tuple(r) for r in kept.contributions.collect()] == [(1_000, 4, 0, 4)]
    assert [edges.count() for edges in given] == [5, 5] and all(f.endswith(".parquet") for f in given[0].inputFiles()) and given[0].inputFiles()


def test_import_after_another_is_made_from_its_edges(spark, small, monkeypatch):
    """Where import 1 is there, import 2 is its edges without some, moved; the tables are not grouped again."""
    whole = source.from_tables(spark, small)
    c = catalog.Context(spark, small)
    assert c.g1.nodes.count() > 0
    monkeypatch.setattr(source, "from_tables", lambda *a, plain=source.from_tables: source.Graph(plain(*a).nodes, None))
    for got, wanted in ((c.g2.edges, whole.of_import(2).edges), (c.g2.nodes, whole.of_import(2).nodes)):
        assert got.columns == wanted.columns and got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty() and not got.isEmpty()
