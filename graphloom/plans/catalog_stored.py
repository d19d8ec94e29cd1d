"""Queries over what is stored: results with lifetimes, and contributions kept up with changes of the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse, contribution, why
from ..sources.folders import Folder, shared_folder
from ..sources.graph import Graph
from ..sources.results import ResultStore
from ..streaming.changes import StoredGraph
from .catalog import _TRI, AS_OF, E1, N1, PART, SUPPLIER, Context, P, _add, _found, _sim, checkpointed

_NOW, _HALF_AN_HOUR, _TWO_HOURS = "2024-06-01 12:00:00", "2024-06-01 12:30:00", "2024-06-01 14:00:00"
_CONTRIB = "id bigint, label string, package_type string, unique_contribution bigint, shared_contribution bigint, total_contribution bigint"
_U, _S, _T = "unique_contribution", "shared_contribution", "total_contribution"


class _Scratch:
    """A folder for one query; what it returns is checkpointed before the folder goes."""

    def __init__(self, c: Context):
        self.spark, self.name = c.spark, f"query-{uuid.uuid4().hex}"
        self.path = f"{shared_folder(c.spark)}/{self.name}"

    def __enter__(self) -> _Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        Folder(self.spark, shared_folder(self.spark)).remove(self.name)


def _stored_contributions(c: Context, store: ResultStore) -> None:
    rows = c.contributions.select("id", "label", "package_type", _U, _S, _T)
    store.put(1, "contribution", rows.withColumn("key", F.col("id").cast("string")), _NOW)
    # a second put of some keys replaces just those rows
    store.put(1, "contribution", rows.where("id % 3 = 0").withColumn("key", F.col("id").cast("string")).withColumn("label", F.upper("label")), _HALF_AN_HOUR, "common")


def _put_get(c: Context) -> DataFrame:
    with _Scratch(c) as scratch:
        store = ResultStore(c.spark, scratch.path)
        _stored_contributions(c, store)
        return checkpointed(store.get(1, "contribution", _HALF_AN_HOUR, _CONTRIB).drop("key"))


def _cleanup(c: Context) -> DataFrame:
    with _Scratch(c) as scratch:
        store = ResultStore(c.spark, scratch.path)
        _stored_contributions(c, store)
        store.cleanup(_TWO_HOURS)  # those stored for an hour go
        return checkpointed(store.get(1, "contribution", _NOW, _CONTRIB).select("id", "label", _T))


def _invalidate(c: Context) -> DataFrame:
    with _Scratch(c) as scratch:
        store = ResultStore(c.spark, scratch.path)
        for i, graph in ((1, c.g1), (2, c.g2)):
            dependents = graph.deps.groupBy(F.col("dependency").cast("string").alias("key")).agg(F.count("*").alias("dependents"))
            store.put(i, "why_chain:dependents", dependents, _NOW)
            store.put(i, "types", graph.nodes.groupBy("package_type").agg(F.count("*").alias("n")).withColumn("key", F.coalesce("package_type", F.lit("none"))), _NOW)
        store.invalidate(1, "why_chain")
        return checkpointed(store.stats().select("import_id", "kind", "entries"))


def _get_or_compute(c: Context) -> DataFrame:
    """Dependents of a node by type of dependency: computed, then read, then computed again when it has expired."""

    def computed() -> DataFrame:
        return why.direct_dependents(c.g1, SUPPLIER).groupBy("dep_type").agg(F.count("*").alias("n"))

    def never() -> DataFrame:
        raise AssertionError("the result is stored and good")

    with _Scratch(c) as scratch:
        store = ResultStore(c.spark, scratch.path)
        read = lambda at, how: store.get_or_compute(1, "why_chain", str(SUPPLIER), at, "dep_type string, n bigint", how)
        parts = [read(_NOW, computed), read(_HALF_AN_HOUR, never), read(_TWO_HOURS, computed)]
        rows = [checkpointed(p.withColumn("reading", F.lit(k))) for k, p in enumerate(parts)]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])


_add("cache_put_get", _put_get, P + f"SELECT id, CASE WHEN id % 3 = 0 THEN upper(label) ELSE label END AS label, package_type, {_U}, {_S}, {_T} FROM contrib")
_add("cache_cleanup", _cleanup, P + f"SELECT id, upper(label) AS label, {_T} FROM contrib WHERE id % 3 = 0")
_add(
    "cache_invalidate",
    _invalidate,
    P + "SELECT import_id, 'types' AS kind, count(DISTINCT coalesce(package_type, 'none')) AS entries FROM nodes WHERE import_id < 3 GROUP BY 1 UNION ALL SELECT import_id, 'why_chain:dependents', count(DISTINCT dependency) FROM deps WHERE import_id = 2 GROUP BY 1",
)
_add("cache_get_or_compute", _get_or_compute, P + f"SELECT dep_type, count(*) AS n, reading FROM deps, (VALUES (0), (1), (2)) r(reading) WHERE dependency = {SUPPLIER} GROUP BY dep_type, reading")


# a change of edges and marks: parts go from every second top-level order, every sixth is top-level no longer
_GONE = "floor(source_id / 1000000000) = 4 and target_id % 100 = 50"


def _after(g: Graph) -> Graph:
    return Graph(g.nodes.withColumn("is_top_level", F.col("is_top_level") & (F.col("id") % 300 != 0)), g.edges.where(f"not ({_GONE})"))


_AFTER = f"""{P}, e2 AS (SELECT dependent, dependency FROM deps WHERE import_id = 1 AND NOT (dependency // 1000000000 = 4 AND dependent % 100 = 50)), t2 AS (SELECT id FROM nodes WHERE import_id = 1 AND is_top_level AND {{0}}),
c2(top_id, dep) AS (SELECT id, dependency FROM t2 JOIN e2 ON dependent = id UNION SELECT top_id, dependency FROM c2 JOIN e2 ON dependent = dep), u2 AS (SELECT dep, count(*) AS users FROM c2 GROUP BY 1)
SELECT top_id AS id, count(*) FILTER (users = 1) AS {_U}, count(*) FILTER (users > 1) AS {_S}, count(*) AS {_T} FROM c2 JOIN u2 USING (dep) GROUP BY 1"""


def _stream_batches(c: Context) -> DataFrame:
    """The same edges removed by a stored graph's batches: one after the other, with a change that comes late and one that comes twice."""
    gone = c.g1.edges.where(_GONE).select(F.lit("remove").alias("action"), F.col("target_id").alias("dependent"), F.col("source_id").alias("dependency"), F.lit(None).cast("string").alias("dep_type"))
    first, second = gone.where("dependency % 2 = 0"), gone.where("dependency % 2 = 1")
    with _Scratch(c) as scratch:
        stored = StoredGraph(c.g1.nodes, scratch.path)
        stored.start(c.g1)
        stored.apply(first.withColumn("sequence", F.lit(5).cast("bigint")), 0)
        stale = first.withColumns({"sequence": F.lit(3).cast("bigint"), "action": F.lit("add")})
        stored.apply(second.unionByName(second).withColumn("sequence", F.lit(6).cast("bigint")).unionByName(stale), 1)
        return checkpointed(stored.kept(2).contributions)


_add("contributions_after_change", lambda c: c.kept.changed(c.g1, _after(c.g1))[0].contributions, _AFTER.format("id % 300 <> 0"))
_add("contributions_after_batches", _stream_batches, _AFTER.format("TRUE"))
_add("usage_states", lambda c: c.kept.states, P + "SELECT dep AS id, CASE WHEN users = 1 THEN user END AS user, users > 1 AS many FROM (SELECT dep, count(*) AS users, min(top_id) AS user FROM top_closure GROUP BY 1)")
_add("contributions_computed", lambda c: contribution.contributions(c.g2), P + f", c2 AS (SELECT c.node AS top_id, c.dep FROM closure c JOIN nodes t ON t.id = c.node AND t.is_top_level WHERE c.import_id = 2), u2 AS (SELECT dep, count(*) AS users FROM c2 GROUP BY 1) SELECT top_id AS id, count(*) FILTER (users = 1) AS {_U}, count(*) FILTER (users > 1) AS {_S}, count(*) AS {_T} FROM c2 JOIN u2 USING (dep) GROUP BY 1")


def _all_stale(c: Context) -> DataFrame:
    """Every second package of two imports was computed a month ago, every third never."""
    at = F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 2 == 0, "2024-05-01 00:00:00").otherwise("2024-06-01 12:00:00"))
    computed = c.raw.nodes.where("is_top_level").select("id", F.to_timestamp_ntz(at).alias("computed_at"))
    return contribution.recompute_all_stale(c.raw, computed, AS_OF).select("import_id", "id", _U, _S, _T)


_add("recompute_all_imports_stale", _all_stale, P + f""", c2 AS (SELECT c.import_id, c.node AS id, c.dep FROM closure c JOIN nodes t ON t.id = c.node AND t.is_top_level), u2 AS (SELECT dep, count(*) AS users FROM c2 GROUP BY 1)
SELECT import_id, id, count(*) FILTER (users = 1) AS {_U}, count(*) FILTER (users > 1) AS {_S}, count(*) AS {_T} FROM c2 JOIN u2 USING (dep) WHERE id % 3 = 0 OR id % 2 = 0 GROUP BY 1, 2""")
# a part with what is around it: the nodes are given, the edges are those between them
_add(
    "subgraph_of_ids",
    lambda c: browse.subgraph(c.g1, ids=browse.around(c.g1, PART, 1).select("id"))[1],
    P + f", s AS (SELECT {PART}::BIGINT AS id UNION SELECT dependency FROM deps WHERE dependent = {PART} UNION SELECT dependent FROM deps WHERE dependency = {PART}) SELECT source_id, target_id, dependency_type FROM {E1} WHERE source_id IN (FROM s) AND target_id IN (FROM s)",
)

# searches read the stored lists of trigrams
_add("label_trigram_counts", lambda c: c.label_index.lists.groupBy("gram").agg(F.count("*").alias("labels"), F.sum("size").alias("sizes")), P + f", x AS (SELECT id, {_TRI.format('label')} AS t FROM {N1}) SELECT gram, count(*) AS labels, sum(size)::BIGINT AS sizes FROM (SELECT unnest(t) AS gram, len(t) AS size FROM x) GROUP BY 1")
for _name, _text, _least in (("search_number", "order-50", 0.5), ("search_prefix", "Supplier#0000000", 0.4), ("search_nothing", "zzz qqq", 0.3), ("search_exact", "EUROPE", 1.0)):
    _add(_name, lambda c, text=_text, least=_least: _found(c, text, least), P + f", x AS (SELECT id, label, {_sim('label', repr(_text))} AS s FROM {N1}) SELECT id, label, round(s, 6) AS sim FROM x WHERE s >= {_least} ORDER BY s DESC, label, id LIMIT 20")
