"""Sinks, readers and the stream of changes."""

from pyspark.sql import functions as F

from graphloom.operators import compare, importing
from graphloom.sources import exports
from graphloom.sources.graph import from_edges


def test_sinks(spark, tmp_path):
    found = compare.categorised(compare.diffs(from_edges(spark, [(1, 2)]), from_edges(spark, [(2, 3)])))
    exports.write_csv(compare.csv_rows(found.drop("category")), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    exports.write_json(compare.json_report(found), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    exports.write_markdown(found, str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert sorted(lines) == sorted(["## Only in the first: Other (1)", "- n1", "## Only in the second: Other (1)", "- n3"])
    name = spark.range(1).select(exports.file_name(F.lit("a b/c"), F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05")), "csv")).first()[0]
    assert name == "a_b_c-20240102-030405.csv"


def test_json_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "b"}\n{"name": "a"}\n{"name": "b"}\n{}\n')
    assert [r.name for r in exports.system_packages(spark, str(tmp_path / "p.json")).collect()] == ["a", "b"]
    (tmp_path / "m.json").write_text('{"drv_name": "x.drv", "metadata": {"system": "s"}}\n')
    nodes = spark.createDataFrame([(1, "x.drv", 0, None), (2, "y.drv", None, None), (3, "x.drv", 1, "{}")], "id bigint, drv_name string, depth bigint, metadata string")
    rows = exports.backfill(nodes, exports.read_metadata(spark, str(tmp_path / "m.json")), 5).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, '{"system":"s"}'), (2, None)]
    packages = spark.createDataFrame([("a", "x"), ("a", "w"), ("b", "x")], "package string, source string")
    assert {r.package: r.modules for r in exports.package_modules(packages).collect()} == {"a": ["w", "x"], "b": ["x"]}


def test_import_of_a_file(spark, tmp_path):
    a, b, c = "a" * 32, "b" * 32, "c" * 32
    text = [f'"{a}-zlib-1.3.drv" [label = "zlib-1.3.drv"];', f'"{b}-curl-8.0.drv" [label = "curl-8.0.drv"];', f'"{a}-zlib-1.3.drv" -> "{b}-curl-8.0.drv" [color = "red"];']
    (tmp_path / "g.dot").write_text("\n".join(["digraph G {", *text, text[2], f'"{c}-gone.drv" -> "{b}-curl-8.0.drv"', "}"]))
    record, graph = importing.import_dot(spark, str(tmp_path / "g.dot"), 7, "host")
    assert [tuple(r) for r in record.collect()] == [(7, "host", 2, 3)]
    ids = {r.label: r.id for r in graph.nodes.collect()}
    assert set(ids) == {"zlib-1.3", "curl-8.0"}
    assert [(r.source_id, r.target_id, r.edge_color) for r in graph.edges.collect()] == [(ids["zlib-1.3"], ids["curl-8.0"], "red")]
    assert {r.id: r.closure_size for r in importing.with_stages(graph).nodes.collect()} == {ids["curl-8.0"]: 1, ids["zlib-1.3"]: None}


def test_enabled_modules(spark, tmp_path):
    (tmp_path / "p").write_text('["zsh", "git"]\n["git", null]\nno list\n')
    (tmp_path / "s").write_text('["git"]\n')
    programs, services = (exports.enabled_modules(spark, str(tmp_path / x)) for x in "ps")
    assert [r.name for r in programs.collect()] == ["git", "zsh"]
    found = {r.package: r.source for r in exports.module_sources(programs, services).collect()}
    assert found == {"git": "services.git.enable", "zsh": "programs.zsh.enable"}
