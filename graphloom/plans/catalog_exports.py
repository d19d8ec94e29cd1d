"""More named queries: full exports, texts of paths and groups, recomputation rules, and changes of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import compare, contribution, dashboard, why
from .catalog import _CAT, _DIFF, AS_OF, Context, P, _add, _version_part
from .catalog_more import _BASE, _COMP, _GROUPS, _OLD, _PS

_VERSION = _version_part(2, "NULL")
_add(
    "diff_csv_full",
    lambda c: compare.csv_export(c.diffs),
    P + _DIFF + f""" SELECT label AS package_label, diff_type, {_CAT} AS category, coalesce(package_type, '') AS package_type,
    CASE WHEN l_id IS NULL THEN '' ELSE coalesce({_VERSION}, '') END AS left_version, CASE WHEN r_id IS NULL THEN '' ELSE coalesce({_VERSION}, '') END AS right_version,
    coalesce(l_hash, '') AS left_drv_hash, coalesce(r_hash, '') AS right_drv_hash, coalesce(l_closure::VARCHAR, '') AS left_closure_size, coalesce(r_closure::VARCHAR, '') AS right_closure_size,
    closure_impact, CASE WHEN l_top THEN 'true' ELSE 'false' END AS left_is_top_level, CASE WHEN r_top THEN 'true' ELSE 'false' END AS right_is_top_level
    FROM diff WHERE diff_type <> 'same'""",
)

_TRACED = "Supplier#000000005"


def _trace_sql(side: str, import_id: int) -> str:
    return f"""SELECT * FROM (SELECT '{side}' AS side, len(path) AS n, array_to_string(path, '→') AS path FROM w WHERE import_id = {import_id} AND len(path) > 1
    AND id NOT IN (SELECT source_id FROM edges) ORDER BY n DESC, array_to_string(w.path, '→') LIMIT 10)"""


_add(
    "package_trace_paths",
    lambda c: compare.package_trace_paths(c.g1, c.g2, _TRACED, 6),
    P + f""", w(import_id, id, path) AS (SELECT import_id, min(id), [min(id)] FROM nodes WHERE label = '{_TRACED}' AND import_id < 3 GROUP BY 1
    UNION ALL SELECT w.import_id, dependent, list_append(path, dependent) FROM w JOIN (SELECT DISTINCT dependent, dependency FROM deps) ON dependency = w.id WHERE len(path) < 6)
    {_trace_sql('left', 1)} UNION ALL {_trace_sql('right', 2)}""",
)

_add(
    "path_texts",
    lambda c: why.path_texts(c.g1, c.paths),
    _PS + """ SELECT top_id, array_to_string(path, '→') AS path, string_agg(label, ' -> ' ORDER BY place) AS text
    FROM (SELECT top_id, path, unnest(path) AS id, generate_subscripts(path, 1) AS place FROM paths) JOIN nodes USING (id) GROUP BY top_id, path""",
)
_add(
    "group_texts",
    lambda c: why.group_texts(why.path_groups(c.g1, c.paths, max_packages=3), 3),
    _PS + _GROUPS.replace("turn <= 5", "turn <= 3") + """ SELECT via_label, top_level_packages || CASE WHEN total_dependents > 3 THEN ' (+' || (total_dependents - 3) || ' more)' ELSE '' END AS text
    FROM (SELECT * FROM gl ORDER BY total_dependents DESC, shortest <= 1 DESC, via_label, via LIMIT 10)""",
)
_add("truncated_labels", lambda c: c.raw.of_import(1).nodes.select("id", L.truncated(F.col("label"), 12).alias("label")), P + "SELECT id, CASE WHEN length(label) > 12 THEN label[:12] || '...' ELSE label END AS label FROM nodes WHERE import_id = 1")

# recomputation: over half of the packages are stale, or twenty of them
_add("needs_recomputation", lambda c: contribution.needs_recomputation(c.computed, AS_OF), P + _COMP + f" SELECT count(*) > 0 AS needs_recomputation FROM comp, lim WHERE {_OLD}")
_NEW = "id, unique_contribution, shared_contribution, total_contribution"


def _fresh(c: Context, most: int | None) -> DataFrame:
    return contribution.recompute_stale(c.g1, c.computed, AS_OF, max_nodes=most, kept=c.kept).select(*_NEW.split(", "), "strategy")


def _fresh_sql(most: str) -> str:
    return f""", old AS (SELECT id FROM comp, lim WHERE {_OLD} ORDER BY computed_at NULLS FIRST, id {most}), rule AS (SELECT (SELECT count(*) FROM old) > 0.5 * (SELECT count(*) FROM comp) AS whole)
    SELECT {_NEW}, CASE WHEN whole THEN 'full' ELSE 'selective' END AS strategy FROM contrib, rule WHERE whole OR id IN (SELECT id FROM old)"""


_add("recompute_stale", lambda c: _fresh(c, None), P + _COMP + _fresh_sql(""))
_add("recompute_stale_some", lambda c: _fresh(c, 5), P + _COMP + _fresh_sql("LIMIT 5"))

# changes of stored rows give the tables as they are afterwards
_add(
    "delete_import",
    lambda c: c.raw.without_import(2).nodes.groupBy("import_id").agg(F.count("*").alias("nodes")).join(c.raw.without_import(2).edges.groupBy("import_id").agg(F.count("*").alias("edges")), "import_id"),
    P + "SELECT import_id, count(*) AS nodes, (SELECT count(*) FROM edges e WHERE e.import_id = nodes.import_id) AS edges FROM nodes WHERE import_id <> 2 GROUP BY import_id",
)
_add("delete_baseline", lambda c: dashboard.without_baseline(c.baselines, 3).select("baseline_id", "name", "node_count"), P + _BASE + " SELECT baseline_id, name, node_count FROM bl WHERE baseline_id <> 3")
_add(
    "update_baseline",
    lambda c: dashboard.updated_baseline(c.baselines, 2, "2024-05-05 00:00:00", name="renamed", tags=("a", "b")).select("baseline_id", "name", F.array_join("tags", ",").alias("tags"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated")),
    P + _BASE + """ SELECT baseline_id, CASE WHEN baseline_id = 2 THEN 'renamed' ELSE name END AS name, CASE WHEN baseline_id = 2 THEN 'a,b' ELSE array_to_string(tags, ',') END AS tags,
    strftime(CASE WHEN baseline_id = 2 THEN TIMESTAMP '2024-05-05' ELSE created_at END, '%Y-%m-%d') AS updated FROM bl""",
)
_add("live_cache_entries", lambda c: dashboard.live_entries(c.computed, AS_OF).select("id", "label"), P + _COMP + " SELECT id, label FROM comp, lim WHERE computed_at >= edge")
