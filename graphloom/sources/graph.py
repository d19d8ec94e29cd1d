"""Dependency graphs as two DataFrames, and the graph that the test tables stand for.

Edges are stored from a dependency (`source_id`) to what needs it (`target_id`). ``Graph.deps`` is the one canonical
form that operators use: (dependent, dependency, dep_type).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import module_type

KIND = 1_000_000_000
NEXT_IMPORT = 100_000_000_000
#: Imports as (id, name, config_path, imported_at).
IMPORTS = [(1, "host", "base", "2024-01-01 00:00:00"), (2, "host", "next", "2024-02-01 00:00:00"), (3, "cyclic", "cyclic", "2024-03-01 00:00:00")]
#: Package types of parts by their type.
PART_TYPES = {"ECONOMY": "library", "PROMO": "development", "LARGE": "application", "MEDIUM": "python-package", "SMALL": "font"}


@dataclass(frozen=True)
class Graph:
    """Nodes and edges of one or more imports."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def deps(self) -> DataFrame:
        return self.edges.select("import_id", F.col("target_id").alias("dependent"), F.col("source_id").alias("dependency"), F.coalesce("dependency_type", F.lit("unknown")).alias("dep_type"))

    def of_import(self, import_id: int) -> Graph:
        return Graph(self.nodes.where(F.col("import_id") == import_id), self.edges.where(F.col("import_id") == import_id))

    def without_import(self, import_id: int) -> Graph:
        return Graph(self.nodes.where(F.col("import_id") != import_id), self.edges.where(F.col("import_id") != import_id))


def from_edges(spark: SparkSession, edges: list[tuple[int, int]], top: tuple[int, ...] = (), convention: str = "A", kinds: dict[tuple[int, int], str] | None = None) -> Graph:
    """A small graph for tests; convention "B" has edges from the dependent to the dependency."""
    kinds = kinds or {}
    rows = [(1, *((b, a) if convention == "B" else (a, b)), kinds.get((a, b), "runtime"), None, False) for a, b in edges]
    ids = sorted({x for e in edges for x in e} | set(top))
    nodes = [(i, 1, f"h{i}", f"n{i}.drv", f"n{i}", "application", i in top, None, "other", None, None) for i in ids]
    return Graph(
        spark.createDataFrame(nodes, "id bigint, import_id bigint, drv_hash string, drv_name string, label string, package_type string, is_top_level boolean, top_level_source string, module_type string, depth bigint, closure_size bigint"),
        spark.createDataFrame(rows, "import_id bigint, source_id bigint, target_id bigint, dependency_type string, edge_color string, is_redundant boolean"),
    )


def imports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IMPORTS, "id bigint, name string, config_path string, imported_at string").withColumn("imported_at", F.to_timestamp_ntz("imported_at"))


def _id(kind: int, key: str):
    return F.lit(kind * KIND) + F.col(key).cast("bigint")


def _of_number(edges: DataFrame, import_id: int) -> DataFrame:
    return edges.select(F.lit(import_id).cast("bigint").alias("import_id"), "source_id", "target_id", "dependency_type", F.lit(None).cast("string").alias("edge_color"), F.lit(False).alias("is_redundant"))


def _following(base: DataFrame) -> DataFrame:
    """The edges of `next` from those of `base`: none of the parts and orders that go."""

    def gone(column: str):
        return (F.floor(F.col(column) / KIND).isin(4, 6)) & (F.col(column) % KIND % 7 == 0)

    return base.where(~gone("source_id") & ~gone("target_id")).select((F.col("source_id") + NEXT_IMPORT).alias("source_id"), (F.col("target_id") + NEXT_IMPORT).alias("target_id"), "dependency_type")


def next_edges(base: DataFrame) -> DataFrame:
    """The edges of import 2 from those of import 1 where they are stored, without another pass over the tables."""
    return _of_number(_following(base), 2)


def from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """Three imports: `base` from all tables, `next` without some parts and orders and with new hashes, `cyclic` with loops of parts."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}

    def nodes(name: str, kind: int, key: str, label, package_type) -> DataFrame:
        return t[name].select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), label.alias("label"), package_type.cast("string").alias("package_type"))

    part_type = F
    for source, found in PART_TYPES.items():
        part_type = part_type.when(F.col("p_type") == source, found)
    part_label = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.pmod("p_size", F.lit(4)).cast("string"), F.lit("."), F.pmod("p_partkey", F.lit(3)).cast("string"))
    raw = nodes("region", 1, "r_regionkey", F.col("r_name"), F.lit("bootstrap"))
    for more in (
        nodes("nation", 2, "n_nationkey", F.col("n_name"), F.lit("configuration")),
        nodes("supplier", 3, "s_suppkey", F.col("s_name"), F.lit("service")),
        nodes("part", 4, "p_partkey", part_label, part_type),
        nodes("customer", 5, "c_custkey", F.col("c_name"), F.lit("library")),
        nodes("orders", 6, "o_orderkey", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), F.lit("application")),
    ):
        raw = raw.unionByName(more)
    tops = t["orders"].where(F.col("o_orderkey") % 50 == 0).select(
        F.lit(6).alias("kind"), F.col("o_orderkey").alias("key"), F.lit(True).alias("is_top_level"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "systemPackages")
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("programs."), F.col("o_orderkey").cast("string"), F.lit(".enable")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("services."), F.col("o_orderkey").cast("string"), F.lit(".enable")))
        .otherwise("custom").alias("top_level_source"),
    )
    # only orders of these keys can be top-level; the others meet no join
    marked = F.coalesce((F.col("kind") == 6) & (F.col("key") % 50 == 0), F.lit(False))
    plain = raw.where(~marked).select("*", F.lit(False).alias("is_top_level"), F.lit(None).cast("string").alias("top_level_source"))
    raw = plain.unionByName(raw.where(marked).join(tops, ["kind", "key"], "left").withColumn("is_top_level", F.coalesce("is_top_level", F.lit(False))))
    cyclic = t["part"].select(F.lit(7).alias("kind"), F.col("p_partkey").alias("key"), F.concat(F.lit("cyc-"), F.col("p_partkey").cast("string")).alias("label"), F.lit("library").alias("package_type"), F.lit(False).alias("is_top_level"), F.lit(None).cast("string").alias("top_level_source"))

    def finished(df: DataFrame, import_id: int) -> DataFrame:
        again = import_id == 2
        mark = F.concat(F.col("kind").cast("string"), F.lit(":"), F.col("key").cast("string"), F.when(F.lit(again) & (F.col("key") % 5 == 0), ":2").otherwise(""))
        return df.select(
            (F.col("kind").cast("bigint") * KIND + F.col("key") + (NEXT_IMPORT if again else 0)).alias("id"), F.lit(import_id).cast("bigint").alias("import_id"), F.md5(mark.cast("binary")).alias("drv_hash"),
            F.concat("label", F.lit(".drv")).alias("drv_name"), "label", "package_type", "is_top_level", "top_level_source",
            F.when(F.col("is_top_level"), module_type(F.col("top_level_source"))).alias("module_type"),
        )

    stays = ~(F.col("kind").isin(4, 6) & (F.col("key") % 7 == 0))
    all_nodes = finished(raw, 1).unionByName(finished(raw.where(stays), 2)).unionByName(finished(cyclic, 3))

    first = t["lineitem"].groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    pairs = t["lineitem"].groupBy("l_partkey", "l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    flag = F.when(F.col("flag") == "R", "build").when(F.col("flag") == "A", "unknown").otherwise("runtime")
    supplied = first.join(t["supplier"], F.col("s") == F.col("s_suppkey"))

    def edges(df: DataFrame, source, target, kind) -> DataFrame:
        return df.select(source.alias("source_id"), target.alias("target_id"), kind.alias("dependency_type"))

    runtime, build = F.lit("runtime"), F.lit("build")
    base = edges(t["nation"], _id(1, "n_regionkey"), _id(2, "n_nationkey"), runtime)
    for more in (
        edges(t["supplier"], _id(2, "s_nationkey"), _id(3, "s_suppkey"), runtime),
        edges(t["customer"], _id(2, "c_nationkey"), _id(5, "c_custkey"), runtime),
        edges(first, _id(3, "s"), _id(4, "l_partkey"), build),
        edges(pairs, _id(4, "l_partkey"), _id(6, "l_orderkey"), flag),
        edges(t["orders"], _id(5, "o_custkey"), _id(6, "o_orderkey"), runtime),
        edges(supplied.where(F.col("l_partkey") % 10 == 0), _id(2, "s_nationkey"), _id(4, "l_partkey"), build),
    ):
        base = base.unionByName(more)
    part = F.col("p_partkey")
    block = F.floor(part / 5)
    count = t["part"].agg(F.max("p_partkey").alias("last"))
    numbered = t["part"].crossJoin(F.broadcast(count))  # one row
    ring = numbered.where(~((part % 5 == 4) & (block % 3 == 0)) & (block * 5 + 4 <= F.col("last")))
    loops = edges(ring, _id(7, "p_partkey"), F.lit(7 * KIND) + F.when(part % 5 == 4, part - 4).otherwise(part + 1), runtime)
    bridges = edges(numbered.where((part % 10 == 0) & (part + 5 <= F.col("last"))), _id(7, "p_partkey"), F.lit(7 * KIND) + part + 5, runtime)
    all_edges = None
    for import_id, df in ((1, base), (2, _following(base)), (3, loops.unionByName(bridges))):
        df = _of_number(df, import_id)
        all_edges = df if all_edges is None else all_edges.unionByName(df)
    return Graph(all_nodes, all_edges)
