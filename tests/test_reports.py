"""Reports as documents: parts in order, a manifest at the end, JSON that parses."""

import json
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.operators import compare, reports
from graphloom.plans import catalog
from graphloom.sources.graph import Graph
from graphloom.sources import documents
from graphloom.sources.documents import manifest, read_document, write_document

DIFFS = "label string, package_type string, diff_type string, l_id bigint, r_id bigint, l_hash string, r_hash string, closure_impact bigint, l_closure bigint, r_closure bigint, l_depth bigint, r_depth bigint, l_top boolean, r_top boolean"
IMPORT = "id bigint, name string, config_path string, imported_at string, node_count bigint"


def sides(spark):
    rows = [spark.createDataFrame([(i, name, None, "2024-01-02 03:04:05", n)], IMPORT).withColumn("imported_at", F.to_timestamp_ntz("imported_at")) for i, name, n in ((1, "old", 4000), (2, "new", 5))]
    return rows


def joined(spark, path):
    """The parts put together in the manifest's order."""
    names = [r.part for r in manifest(spark, path).orderBy("first").collect()]
    return "".join((Path(path) / name).read_text() for name in names), len(names)


def test_document_keeps_order_over_parts(spark, tmp_path):
    numbers = list(range(1_000)) + [7] * 5
    random.Random(1).shuffle(numbers)
    lines = spark.createDataFrame([(n, f"line {n}" if n % 10 else "" if n % 20 else "a\nb") for n in numbers], "n int, line string").repartition(7)
    write_document(lines, ["n"], f"{tmp_path}/d", part_lines=40)
    wanted = [f"line {n}" if n % 10 else "" if n % 20 else "a b" for n in sorted(numbers)]
    text, parts = joined(spark, f"{tmp_path}/d")
    assert text.split("\n")[:-1] == wanted and parts >= len(wanted) / 40
    assert [(r.number, r.line) for r in read_document(spark, f"{tmp_path}/d").orderBy("number").collect()] == list(enumerate(wanted))
    assert all(r.lines <= 40 for r in manifest(spark, f"{tmp_path}/d").collect())


def test_document_cut_short_is_not_there(spark, tmp_path):
    spark.range(5).selectExpr("string(id) as line").write.text(f"{tmp_path}/d")  # the parts without a manifest
    with pytest.raises(FileNotFoundError):
        read_document(spark, f"{tmp_path}/d")


ROWS = [
    ("gcc-12.1", None, "different", 1, 11, "a", "b", 5, 10, 15, 1, 2, True, False), ('q"uote\\d', "library", "only_left", 2, None, "c", None, -3, 3, None, None, None, False, None),
    ("gcc-12.1", None, "different", 1, 12, "a", "d", 0, 10, 10, 1, 1, True, None), ("zsh", "application", "only_right", None, 13, None, "e", 1234, None, 1234, None, 4, None, True),
    ("same", "library", "same", 3, 14, "s", "s", 0, 1, 1, 1, 1, False, False), ("bash", "application", "only_right", None, 15, None, "f", 0, None, None, None, None, None, False),
]


def test_comparison_json_parses(spark, tmp_path):
    write_document(reports.comparison_json(spark.createDataFrame(ROWS, DIFFS), *sides(spark), "now"), reports.PLACE, f"{tmp_path}/j", part_lines=3)
    report = json.loads(joined(spark, f"{tmp_path}/j")[0])
    assert report["metadata"] == {"generated_at": "now", "report_version": "1.0", "generator": "graphloom"}
    assert report["summary"]["left_import"] == {"id": 1, "name": "old", "config_path": None, "node_count": 4000, "imported_at": "2024-01-02T03:04:05"}
    assert report["summary"]["statistics"] == {"left_only_count": 1, "right_only_count": 2, "different_count": 2, "same_count": 1, "net_change": 1}
    assert [d["label"] for d in report["diffs"]["only_right"]] == ["bash", "zsh"] and report["diffs"]["only_right"][1]["node"] == {"id": 13, "drv_hash": "e", "closure_size": 1234, "depth": 4, "is_top_level": True}
    assert report["diffs"]["only_left"][0]["label"] == 'q"uote\\d' and report["diffs"]["only_left"][0]["node"]["depth"] is None
    first, second = report["diffs"]["different"]
    assert (first["left_version"], first["right_version"], first["closure_impact"]) == ("12.1", "12.1", 5) and first["right_node"] == {"id": 11, "drv_hash": "b", "closure_size": 15}
    assert second["right_node"]["id"] == 12 and first["package_type"] is None
    totals = Counter(d["category"] for kind in report["diffs"].values() for d in kind)
    assert {name: group["total"] for name, group in report["by_category"].items()} == totals and sum(g["only_right"] for g in report["by_category"].values()) == 2


def test_comparison_json_without_differences(spark, tmp_path):
    write_document(reports.comparison_json(spark.createDataFrame([], DIFFS), *sides(spark), "now"), reports.PLACE, f"{tmp_path}/j")
    report = json.loads(joined(spark, f"{tmp_path}/j")[0])
    assert report["diffs"] == {"only_left": [], "only_right": [], "different": []} and report["by_category"] == {}


def test_comparison_markdown(spark, tmp_path):
    write_document(reports.comparison_markdown(spark.createDataFrame(ROWS, DIFFS), *sides(spark), "now"), reports.PLACE, f"{tmp_path}/m", part_lines=7)
    lines = joined(spark, f"{tmp_path}/m")[0].split("\n")[:-1]
    assert lines[0] == "# Configuration Comparison Report" and "| **old** | 4,000 |" in lines and "**Net change:** +1 packages in new" in lines
    at = lines.index("## Packages Only in new")
    assert lines[at + 2] == "*2 packages*" and lines[at + 6 : at + 9] == ["- `bash`", "- `zsh` (closure: 1,234)", ""] and lines[at + 4].endswith("(2)")
    at = lines.index("## Version Differences")
    assert lines[at + 4 :] == ["| Package | Left Version | Right Version |", "|---------|-------------|---------------|"] + ["| `gcc-12.1` | 12.1 | 12.1 |"] * 2 + ["", "---", "", "*Report generated by graphloom*"]
    write_document(reports.comparison_markdown(spark.createDataFrame([], DIFFS), *sides(spark), "now"), reports.PLACE, f"{tmp_path}/e")
    assert not any(line.startswith("## ") and line != "## Summary" for line in joined(spark, f"{tmp_path}/e")[0].split("\n"))


@pytest.mark.parametrize("copies", [1_024, 4])
def test_entries_without_stored_pairs(spark, monkeypatch, copies):
    """The same entries as from the pairs, with null labels, types, hashes and ids of both sides, and a label dealt to many units."""
    monkeypatch.setattr(compare, "UNIT_COPIES", copies)
    columns = "id bigint, label string, drv_hash string, package_type string, closure_size bigint, is_top_level boolean, depth bigint"
    draw = random.Random(5)
    pick = lambda *values: draw.choice(values)
    side = lambda at: Graph(spark.createDataFrame([(at + i, pick("gcc-12.1", 'q"\\u', "b", None, f"x{at}"), pick("h1", 'h"2', None), pick("library", "font", None), pick(1, 5, None), pick(True, None), pick(2, None)) for i in range(60)], columns), None)
    left, right = side(0), side(1_000)
    wanted = reports.entries(compare.diffs(left, right))
    got = reports.all_entries(left, right)
    assert got.columns == wanted.columns and got.count() > 300
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def two_sides(spark):
    """Nodes with copies of labels and hashes on both sides, nulls everywhere, a label of one side and a node without an id on each."""
    columns = "id bigint, label string, drv_hash string, package_type string, closure_size bigint, is_top_level boolean, depth bigint"
    draw = random.Random(11)
    pick = lambda *values: draw.choice(values)
    row = lambda i, at: (i, pick("gcc-12.1", 'q"\\u', "b", "zz\nz", None, f"x{at}", f"y{at}"), pick("h1", "h1", 'h"2', None), pick("library", "font", None), pick(1, 5, None), pick(True, None), pick(2, None))
    side = lambda at: Graph(spark.createDataFrame([row(at + i, at) for i in range(70)] + [(None, "b", "h1", None, 7, True, None)], columns), None)
    return side(0), side(1_000)


@pytest.mark.parametrize("copies", [1_024, 4])
@pytest.mark.parametrize("kind", ["json", "markdown"])
def test_numbered_reports_without_pairs(spark, tmp_path, monkeypatch, kind, copies):
    """The lines in order are those made from all pairs, where blocks and runs are whole or short; written by number they are the document."""
    monkeypatch.setattr(compare, "UNIT_COPIES", copies)
    monkeypatch.setattr(reports, "RUN_LINES", copies)
    left, right = two_sides(spark)
    from_pairs, direct = {"json": (reports.comparison_json, reports.numbered_json), "markdown": (reports.comparison_markdown, reports.numbered_markdown)}[kind]
    place = lambda r: [(r[c] is not None, r[c]) for c in reports.PLACE]
    wanted = [r.line for r in sorted(from_pairs(compare.diffs(left, right), *sides(spark), "now").collect(), key=place)]
    lines = direct(left, right, *sides(spark), "now")
    assert lines.dtypes == [("number", "bigint"), ("line", "string")]
    got = sorted(map(tuple, lines.collect()))
    assert len(wanted) > 300 and got == list(enumerate(wanted))
    write_document(lines, ["number"], f"{tmp_path}/d")
    assert joined(spark, f"{tmp_path}/d")[0].split("\n")[:-1] == [(line or "").replace("\n", " ") for line in wanted]


@pytest.mark.parametrize("kind", ["json", "markdown"])
def test_numbered_reports_of_one_node_or_none(spark, kind):
    left, right = two_sides(spark)
    from_pairs, direct = {"json": (reports.comparison_json, reports.numbered_json), "markdown": (reports.comparison_markdown, reports.numbered_markdown)}[kind]
    some = lambda g, rows: Graph(g.nodes.where(rows), None)
    place = lambda r: [(r[c] is not None, r[c]) for c in reports.PLACE]
    for rows in ("id = 5", "false"):
        l, r = some(left, rows), some(right, "false")
        wanted = [x.line for x in sorted(from_pairs(compare.diffs(l, r), *sides(spark), "now").collect(), key=place)]
        assert sorted(map(tuple, direct(l, r, *sides(spark), "now").collect())) == list(enumerate(wanted))


def test_report_queries_make_no_pairs_and_agree_on_copies(spark, small, tmp_path, monkeypatch):
    """Tables three times over with other keys and some names missing: the lines of the SQL, and ``diffs`` isn't made."""
    monkeypatch.setattr(catalog, "_contexts", {})
    con = duckdb.connect()
    keys = {"region": {}, "nation": {}, "customer": {"c_custkey": 200}, "supplier": {"s_suppkey": 50}, "part": {"p_partkey": 300}, "orders": {"o_orderkey": 2_000, "o_custkey": 200}, "lineitem": {"l_orderkey": 2_000, "l_partkey": 300, "l_suppkey": 50}}
    for table, spans in keys.items():
        shifted = [f"({c} + i * {span})::BIGINT AS {c}" for c, span in spans.items()] + ["nullif(c_name, 'Customer#000000007') AS c_name"] * (table == "customer")
        con.sql(f"copy (select * {'exclude (i) replace (' + ', '.join(shifted) + ')' if shifted else 'exclude (i)'} from '{small}/{table}.parquet', range({3 if spans else 1}) t(i)) to '{tmp_path}/{table}.parquet'")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    for name in ("comparison_json", "comparison_markdown"):
        got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
        assert got == con.sql(f"select number, line from ({catalog.oracle_sql()[name]}) order by 1").fetchall()
    assert "diffs" not in vars(catalog.context(spark, str(tmp_path)))


def test_part_numbers_are_not_taken_from_the_job(spark):
    """A job's id may begin with c and a digit, which gave all files of a task one number and the document another order."""
    names = spark.createDataFrame([("part-00003-c6a031d7-f1d2-433f-8616-9dcb6dac8438-c012.txt",)], "part string")
    assert tuple(names.select(*[F.regexp_extract("part", documents._PART_NAME, group) for group in (1, 2)]).first()) == ("00003", "012")
