"""More named queries: contributions, attribution, variants, roll-ups, dashboards and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import contribution, dashboard, fixpoint, importing, treemap, validate, variants, why, zoom
from .catalog import AS_OF, BY, CL, CUSTOMER, D1, E1, LABEL, N1, ORDER, PART, SUPPLIER, P, _add

# contributions
_U, _S, _T = "unique_contribution", "shared_contribution", "total_contribution"
_add("contributions", lambda c: c.contributions.select("id", "label", _U, _S, _T).orderBy(F.col(_U).desc(), "label"), P + f"SELECT id, label, {_U}, {_S}, {_T} FROM contrib")
_add("compute_closure", lambda c: fixpoint.closure_pairs(c.g1.deps, c.g1.nodes.where(F.col("id") == ORDER).select(F.col("id").alias("seed"))), P + f"SELECT node, dep FROM closure WHERE node = {ORDER}")
_add("contributions_of_some", lambda c: contribution.recomputed(c.g1, c.computed.where("computed_at is null"), c.kept), P + f"SELECT id, {_U}, {_S}, {_T} FROM contrib WHERE id % 3 = 0")
for _by, _order in (("unique", f"{_U} DESC, label, id"), ("total", f"{_T} DESC, label, id"), ("label", "label, id")):
    _add(f"contributions_by_{_by}", lambda c, b=_by: contribution.ranked(c.contributions, b).select("id", "label", _U, _T), P + f"SELECT id, label, {_U}, {_T} FROM contrib ORDER BY {_order} LIMIT 20")
_add("contribution_summary", lambda c: contribution.summary(c.contributions), P + f"SELECT count(*) AS top_level_count, sum({_U})::BIGINT AS unique_sum, sum({_S})::BIGINT AS shared_sum, sum({_T})::BIGINT AS total_sum, round(avg({_U}), 6) AS average_unique, round(sum({_S})::DOUBLE / sum({_T}), 6) AS sharing_ratio FROM contrib")
_add("contribution_of_node", lambda c: c.contributions.where(F.col("id") == ORDER).select("id", _U, _S, _T), P + f"SELECT id, {_U}, {_S}, {_T} FROM contrib WHERE id = {ORDER}")
_add("removal_candidates", lambda c: contribution.removal_candidates(c.contributions, 1).select("id", "label", _U, _S), P + f"SELECT id, label, {_U}, {_S} FROM contrib WHERE {_U} <= 1 ORDER BY {_U}, {_S} DESC, label, id LIMIT 20")
_add("contribution_by_type", lambda c: contribution.by_type(c.contributions), P + f"SELECT package_type, count(*) AS packages, sum({_U})::BIGINT AS unique_sum, sum({_S})::BIGINT AS shared_sum, sum({_T})::BIGINT AS total_sum FROM contrib GROUP BY 1")
_add("contribution_texts", lambda c: c.contributions.select("id", F.round(contribution.unique_share(F.col(_U), F.col(_T)), 6).alias("percent"), contribution.removal_text(F.col(_U), F.col(_T)).alias("text")), P + f", x AS (SELECT id, {_U} AS u, 100.0::DOUBLE * {_U} / {_T} AS s FROM contrib) SELECT id, round(s, 6) AS percent, CASE WHEN u = 0 THEN 'No unique dependencies - safe to remove' ELSE CASE WHEN s > 75 THEN 'High' WHEN s > 25 THEN 'Medium' ELSE 'Low' END || ' impact - ' || u || ' unique deps would be removed' END AS text FROM x")
_C2 = f", t2 AS (SELECT c.node, c.dep FROM closure c JOIN nodes t ON t.id = c.node AND t.is_top_level WHERE c.import_id = 2), u2 AS (SELECT dep, count(*) AS users FROM t2 GROUP BY 1), contrib2 AS (SELECT label, count(*) FILTER (users = 1) AS {_U}, count(*) AS {_T} FROM t2 JOIN u2 USING (dep) JOIN nodes ON nodes.id = node GROUP BY node, label)"
_add("contribution_diff", lambda c: contribution.contribution_diff(c.contributions, contribution.named(c.g2, contribution.contributions(c.g2))), P + _C2 + f" SELECT coalesce(l.label, r.label) AS label, coalesce(r.{_U}, 0) - coalesce(l.{_U}, 0) AS unique_diff, coalesce(r.{_T}, 0) - coalesce(l.{_T}, 0) AS total_diff FROM contrib l FULL JOIN contrib2 r ON l.label = r.label")

_add("contributions_all_imports", lambda c: contribution.contributions(c.raw), P + _C2.replace("SELECT label, count(*) FILTER", "SELECT node AS id, label, count(*) FILTER (users > 1) AS shared, count(*) FILTER") + f" SELECT id, {_U}, {_S}, {_T} FROM contrib UNION ALL SELECT id, {_U}, shared, {_T} FROM contrib2")

# staleness
_COMP = f", comp AS (SELECT id, label, top_level_source, closure_size, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' ELSE TIMESTAMP '2024-06-01 12:00:00' END END AS computed_at FROM {N1} WHERE is_top_level), lim AS (SELECT TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS edge)"
_OLD = "(computed_at IS NULL OR computed_at < edge)"
_add("staleness_report", lambda c: contribution.staleness(c.computed, AS_OF), P + _COMP + " SELECT count(*) AS top_level_count, count(*) FILTER (computed_at IS NULL) AS never, count(*) FILTER (computed_at < edge) AS stale, strftime(min(computed_at), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(computed_at), '%Y-%m-%d %H:%M:%S') AS newest FROM comp, lim")
_add("staleness_by_source", lambda c: contribution.staleness_by_source(c.computed, AS_OF), P + _COMP + f" SELECT top_level_source, count(*) AS packages, count(*) FILTER ({_OLD}) AS stale FROM comp, lim GROUP BY 1")
_add("mark_stale", lambda c: contribution.marked_stale(c.computed, c.g1.nodes.where("id % 4 = 0").select("id")).select("id", F.col("computed_at").isNull().alias("is_null")), P + _COMP + " SELECT id, computed_at IS NULL OR id % 4 = 0 AS is_null FROM comp")
_add("stale_contributions", lambda c: contribution.stale_ids(c.computed, AS_OF, limit=40).select("id"), P + _COMP + f" SELECT id FROM comp, lim WHERE {_OLD} ORDER BY computed_at NULLS FIRST, id LIMIT 40")
_add("recompute_selective", lambda c: contribution.recomputed(c.g1, contribution.stale_ids(c.computed, AS_OF), c.kept), P + _COMP + f" SELECT id, {_U}, {_S}, {_T} FROM contrib JOIN comp USING (id), lim WHERE {_OLD}")
_UP = "w(id) AS (SELECT {0}::BIGINT UNION SELECT dependent FROM w JOIN deps ON dependency = w.id)"
_AFF = " SELECT id, label FROM nodes JOIN w USING (id) WHERE is_top_level"
_add("affected_by_edge", lambda c: contribution.affected_by_edge(c.g1, PART), P + ", " + _UP.format(PART) + _AFF)
_add("affected_by_node", lambda c: contribution.affected_by_node(c.g1, CUSTOMER), P + ", " + _UP.format(CUSTOMER) + _AFF)
_add("affected_by_top_level", lambda c: contribution.affected_by_top_level(c.g1), P + f"SELECT id, label FROM {N1} WHERE is_top_level")
_add("affected_by_change", lambda c: contribution.recomputed(c.g1, contribution.affected_by_change(c.g1, "node", CUSTOMER), c.kept), P + ", " + _UP.format(CUSTOMER) + f" SELECT id, {_U}, {_S}, {_T} FROM contrib JOIN w USING (id)")
_add("recomputation_cost", lambda c: contribution.recomputation_cost(c.computed_sizes, contribution.stale_ids(c.computed, AS_OF)), P + _COMP + f", k AS (SELECT count(*) AS n, count(*) FILTER ({_OLD}) AS s, avg({CL}) AS m FROM comp, lim) SELECT n AS top_level_count, s AS stale_count, round(n * 10 * (1 + m / 1000), 6) AS full_ms, round(s * 10 * (1 + m / 1000), 6) AS incremental_ms, round(100 * (n - s)::DOUBLE / n, 6) AS savings_percent, CASE WHEN s = 0 THEN 'none' WHEN s > 0.5 * n THEN 'full' ELSE 'incremental' END AS recommendation FROM k")
_add("last_computation", lambda c: contribution.last_computation(c.computed), P + _COMP + " SELECT strftime(max(computed_at), '%Y-%m-%d %H:%M:%S') AS last_computed FROM comp")

# attribution
_add("reverse_edges", lambda c: why.reverse_edges(c.g1, include_build=False), P + f"SELECT dependency, dependent, dep_type FROM {D1} WHERE dep_type = 'runtime'")
_add("direct_dependents", lambda c: why.direct_dependents(c.g1, PART), P + f"SELECT dependent AS id, label, dep_type FROM deps JOIN nodes ON nodes.id = dependent WHERE dependency = {PART}")
_PATHS = """, tops AS (SELECT id FROM nodes WHERE is_top_level AND import_id = 1), up(id, path, ok) AS (SELECT {0}::BIGINT, [{0}::BIGINT], TRUE UNION ALL SELECT dependent, list_prepend(dependent, path), ok AND dep_type IN ('runtime', 'unknown') FROM up JOIN deps ON dependency = up.id WHERE len(path) <= 10 AND up.id NOT IN (FROM tops) AND NOT list_contains(path, dependent)),
paths AS (SELECT id AS top_id, path, len(path) - 1 AS length, ok AS is_runtime FROM up WHERE id IN (FROM tops))"""
_PS = P + _PATHS.format(SUPPLIER)
_add("attribution_paths", lambda c: why.written(c.paths), _PS + " SELECT top_id, array_to_string(path, '→') AS path, length, is_runtime FROM paths")
_add("attribution_paths_capped", lambda c: why.written(why.attribution_paths(c.g1, 2_000_000_001)), P + _PATHS.format(2_000_000_001) + " SELECT top_id, array_to_string(path, '→') AS path, length, is_runtime FROM paths ORDER BY length, paths.path LIMIT 100")
_add("attribution_of_top_level", lambda c: why.written(why.attribution_paths(c.g1, ORDER)), P + f"SELECT {ORDER}::BIGINT AS top_id, '{ORDER}' AS path, 0::BIGINT AS length, TRUE AS is_runtime")
_ESS = """, k AS (SELECT top_id, bool_or(is_runtime) AS runtime, sum(length) FILTER (is_runtime) AS rl, count(*) FILTER (is_runtime) AS rp, sum(length) AS l, count(*) AS n, max(length) AS longest, bool_or(length = 1) AS direct FROM paths GROUP BY 1),
o AS (SELECT count(*) FILTER (runtime) AS rd, count(*) FILTER (NOT runtime) AS bd, coalesce(sum(n), 0)::BIGINT AS paths, coalesce(sum(l)::DOUBLE / sum(n), 0) AS al, coalesce(max(longest), 0) AS ml, coalesce(bool_or(direct), FALSE) AS d, coalesce(sum(rl)::DOUBLE / sum(rp), 0) AS arl FROM k),
ess AS (SELECT CASE WHEN paths = 0 THEN 'orphan' WHEN rd = 0 THEN 'build_only' WHEN arl > 5 THEN 'essential_deep' WHEN rd = 1 THEN 'essential_single' ELSE 'essential' END AS status, rd AS runtime_dependents, bd AS build_dependents, paths, round(al, 6) AS avg_length, ml AS max_length, d AS is_direct, CASE WHEN d THEN 'direct' WHEN al <= 2 THEN 'shallow' WHEN al <= 5 THEN 'moderate' ELSE 'deep' END AS depth_category FROM o)"""
_add("essentiality", lambda c: why.essentiality(c.paths), _PS + _ESS + " SELECT * FROM ess")
_add("essentiality_of_part", lambda c: why.essentiality(why.attribution_paths(c.g1, PART, max_paths=None)), P + _PATHS.format(PART) + _ESS + " SELECT * FROM ess")
_UNIQ = """, own(id, d) AS (SELECT {0}::BIGINT, 0 UNION SELECT dependency, d + 1 FROM own JOIN deps ON dependent = own.id WHERE d < 20), others AS (SELECT id FROM nodes WHERE is_top_level AND import_id = 1 AND id NOT IN (SELECT dependent FROM deps WHERE dependency = {0})),
taken AS (SELECT id FROM others UNION SELECT dep FROM closure WHERE node IN (SELECT id FROM others)), uniq AS (SELECT DISTINCT id FROM own WHERE d > 0 AND id NOT IN (SELECT id FROM taken))"""
_add("unique_dependencies", lambda c: why.unique_dependencies(c.g1, PART), P + _UNIQ.format(PART) + " SELECT id, label FROM uniq JOIN nodes USING (id) ORDER BY label, id LIMIT 50")
_UNIQ_ALL = _UNIQ.replace("own(id, d) AS (SELECT {0}::BIGINT, 0 UNION SELECT dependency, d + 1 FROM own JOIN deps ON dependent = own.id WHERE d < 20)", "own(id) AS (SELECT dep FROM closure WHERE node = {0})").replace("d > 0 AND ", "")
_add("removal_impact", lambda c: why.removal_impact(c.g1, SUPPLIER, c.paths), _PS + _ESS + _UNIQ_ALL.format(SUPPLIER) + ", z AS (SELECT *, status IN ('orphan', 'build_only', 'removable') AS safe, (SELECT count(*) + 1 FROM uniq) AS r FROM ess) SELECT runtime_dependents AS affected_count, r AS closure_reduction, safe AS removal_safe, CASE WHEN safe THEN 'safe' WHEN runtime_dependents = 0 THEN 'low' WHEN runtime_dependents = 1 THEN 'medium' ELSE 'high' END AS impact_level, CASE WHEN safe THEN 'Safe to remove. Would reduce closure by ' || r || ' packages.' WHEN runtime_dependents = 1 THEN 'Would break ' || (SELECT min(label) FROM paths JOIN nodes ON nodes.id = top_id WHERE is_runtime) || '.' WHEN runtime_dependents = 0 THEN 'Cannot determine impact.' ELSE 'Would break ' || runtime_dependents || ' packages.' END AS summary FROM z")
_add("top_level_dependents", lambda c: why.top_level_count(c.g1, SUPPLIER), P + ", " + _UP.format(SUPPLIER) + " SELECT count(*) AS top_level_dependents FROM w JOIN nodes USING (id) WHERE is_top_level")
_GROUPS = """, v AS (SELECT CASE WHEN length <= 1 THEN path[-1] ELSE path[-2] END AS via, top_id, min(length) AS length, bool_or(is_runtime) AS r FROM paths GROUP BY 1, 2),
rk AS (SELECT v.*, label AS tl, row_number() OVER (PARTITION BY via ORDER BY lower(label), label, top_id) AS turn FROM v JOIN nodes ON nodes.id = top_id),
grp AS (SELECT via, count(*) AS total_dependents, min(length) AS shortest, bool_or(r) AS any_runtime, string_agg(tl, ', ' ORDER BY turn) FILTER (turn <= 5) AS top_level_packages FROM rk GROUP BY 1), gl AS (SELECT grp.*, label AS via_label FROM grp JOIN nodes ON nodes.id = via)"""
_GTOP = "SELECT * FROM gl ORDER BY total_dependents DESC, shortest <= 1 DESC, via_label, via LIMIT 10"
_add("path_groups", lambda c: why.path_groups(c.g1, c.paths), _PS + _GROUPS + " " + _GTOP)
_add("first_hop_groups", lambda c: why.first_hop_groups(c.paths), _PS + " SELECT path[2] AS first_hop, count(*) AS paths, count(DISTINCT top_id) AS top_level_packages FROM paths WHERE length > 0 GROUP BY 1")
def _text_sql(target: str) -> str:
    return f""", other AS (SELECT via_label, total_dependents AS d, row_number() OVER (ORDER BY total_dependents DESC, via_label, shortest) AS turn FROM gl WHERE shortest > 1), total AS (SELECT count(DISTINCT top_id) AS n FROM paths)
SELECT CASE WHEN (SELECT n FROM total) = 0 THEN '{target} is not required by any top-level package' WHEN (SELECT n FROM total) = 1 THEN '{target} is needed by ' || (SELECT min(label) FROM paths JOIN nodes ON nodes.id = top_id)
ELSE '{target} is needed by ' || (SELECT n FROM total) || ' top-level packages: ' || concat_ws(', ', (SELECT CASE WHEN total_dependents = 1 THEN 'directly by ' || top_level_packages ELSE 'directly by ' || total_dependents || ' packages' END FROM gl WHERE shortest <= 1),
(SELECT string_agg(CASE WHEN d = 1 THEN 'via ' || via_label ELSE 'via ' || via_label || ' (' || d || ')' END, ', ' ORDER BY turn) FROM other WHERE turn <= 3), (SELECT CASE WHEN count(*) > 3 THEN 'and ' || (count(*) - 3) || ' more paths' END FROM other)) END AS summary"""


_add("attribution_text", lambda c: why.summary_text(why.path_groups(c.g1, c.paths, None), c.paths, "Supplier-1"), _PS + _GROUPS + _text_sql("Supplier-1"))


def _text_of_part(c: Context):
    paths = why.attribution_paths(c.g1, PART, max_paths=None)
    return why.summary_text(why.path_groups(c.g1, paths, None), paths, "the-part")


_add("attribution_text_of_part", _text_of_part, P + _PATHS.format(PART) + _GROUPS + _text_sql("the-part"))
_add("attribution_summary", lambda c: why.attribution_summary(c.g1), P + f"SELECT (SELECT count(*) FROM {N1}) AS nodes, (SELECT count(*) FROM {N1} WHERE is_top_level) AS top_level, count(*) AS edges, count(*) FILTER (dependency_type = 'runtime') AS runtime_edges, count(*) FILTER (dependency_type = 'build') AS build_edges, count(*) FILTER (dependency_type = 'unknown') AS unknown_edges FROM {E1}")
_add("module_breakdown", lambda c: why.module_breakdown(c.g1, c.paths), _PS + ", k AS (SELECT DISTINCT module_type AS kind, top_level_source, id FROM nodes JOIN paths ON top_id = id) SELECT kind, count(*) AS packages, count(DISTINCT top_level_source) AS sources, list_position(['systemPackages', 'programs', 'services', 'other'], kind)::BIGINT AS place FROM k GROUP BY 1")
_add("module_attribution", lambda c: c.g1.nodes.where("is_top_level").select("id", "module_type", F.substring_index("top_level_source", ".", 1).alias("short_source")), P + f"SELECT id, module_type, split_part(top_level_source, '.', 1) AS short_source FROM {N1} WHERE is_top_level")
_add("primary_source", lambda c: why.primary_source(c.g1), P + f", k AS (SELECT module_type AS kind, count(*) AS n FROM {N1} WHERE is_top_level GROUP BY 1) SELECT CASE WHEN max(n) > 0.5 * sum(n) THEN arg_max(kind, n) ELSE 'mixed' END AS primary_source, sum(n)::BIGINT AS total FROM k")
_ALL = f""", tops AS (SELECT id FROM nodes WHERE is_top_level AND import_id = 1), up(v, id, path) AS (SELECT id, id, [id] FROM {N1} WHERE label = {LABEL} UNION ALL SELECT v, dependent, list_prepend(dependent, path) FROM up JOIN (SELECT DISTINCT dependent, dependency FROM deps) ON dependency = up.id WHERE len(path) <= 10 AND up.id NOT IN (FROM tops) AND NOT list_contains(path, dependent)),
each AS (SELECT DISTINCT v, id AS top_id, CASE WHEN len(path) > 2 THEN path[-2] END AS via FROM up WHERE id IN (FROM tops) AND len(path) > 1)"""
_add("sankey", lambda c: why.sankey(c.g1, c.label), P + _ALL + ", links AS (SELECT top_id AS source, v AS target, 1 AS value FROM each WHERE via IS NULL UNION ALL SELECT via, v, count(*) FROM each WHERE via IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT top_id, via, 1 FROM each WHERE via IS NOT NULL) SELECT source, target, sum(value)::BIGINT AS value FROM links GROUP BY 1, 2")
_add("top_level_apps", lambda c: why.top_level_apps(c.s1, c.label), P + f", w(id) AS (SELECT id FROM {N1} WHERE label = {LABEL} UNION SELECT dependent FROM w JOIN deps ON dependency = w.id) SELECT label, min(id) AS id, arg_min({CL}, id) AS closure_size FROM n JOIN w USING (id) WHERE is_top_level GROUP BY label ORDER BY closure_size DESC, label LIMIT 50")
_add("attribution_csv", lambda c: why.csv_rows(why.path_groups(c.g1, c.paths), "Supplier-1"), _PS + _GROUPS + f" SELECT 'Supplier-1' AS target, via_label, total_dependents, shortest, any_runtime, top_level_packages FROM ({_GTOP})")
_add("attribution_json", lambda c: why.json_rows(why.path_groups(c.g1, c.paths)), _PS + _GROUPS + """ SELECT via_label, '{"via_label":"' || via_label || '","total_dependents":' || total_dependents || ',"shortest":' || shortest || '}' AS json FROM (""" + _GTOP + ")")

# variants
_VAR = f", v AS (SELECT id AS vid, drv_hash FROM {N1} WHERE label = {LABEL} ORDER BY drv_hash, id LIMIT 20), cells AS (SELECT * FROM (SELECT vid, v.drv_hash, dependent, label AS app, dep_type, row_number() OVER (PARTITION BY vid ORDER BY is_top_level DESC, label, dependent) AS turn FROM v JOIN deps ON dependency = vid JOIN nodes ON nodes.id = dependent) WHERE turn <= 50), apps AS (SELECT DISTINCT dependent, app FROM cells ORDER BY app, dependent LIMIT 100)"
_add("variant_matrix", lambda c: variants.variant_matrix(c.g1, c.label), P + _VAR + " SELECT apps.app, v.drv_hash, cells.vid IS NOT NULL AS has_dep, cells.dep_type FROM apps CROSS JOIN v LEFT JOIN cells ON cells.dependent = apps.dependent AND cells.vid = v.vid")
_add("variant_types", lambda c: variants.variant_types(c.g1, c.label), P + f"SELECT v.drv_hash, count(dep_type) AS dependents, CASE WHEN count(DISTINCT dep_type) = 1 THEN min(dep_type) WHEN count(DISTINCT dep_type) > 1 THEN 'mixed' END AS dep_type FROM {N1} v LEFT JOIN deps ON dependency = v.id WHERE v.label = {LABEL} GROUP BY 1")
_add("variant_labels", lambda c: variants.variant_labels(c.g1), P + f", o AS (SELECT label, count(DISTINCT drv_hash) AS variants FROM {N1} GROUP BY 1 HAVING variants >= 2), d AS (SELECT label, count(DISTINCT dependent) AS dependents FROM {N1} v JOIN deps ON dependency = v.id GROUP BY 1) SELECT label, variants, coalesce(dependents, 0) AS dependents FROM o LEFT JOIN d USING (label) ORDER BY variants DESC, dependents DESC, label LIMIT 50")
_add("variant_summary", lambda c: variants.variant_summary(c.s1, c.label), P + f"SELECT count(*) AS nodes, count(DISTINCT drv_hash) AS variants, sum({CL})::BIGINT AS total_closure, (SELECT count(DISTINCT dependent) FROM {N1} v JOIN deps ON dependency = v.id WHERE v.label = {LABEL}) AS dependents FROM {N1} WHERE label = {LABEL}")

# treemaps
_TM = ", src AS (SELECT {0} AS grp, label, greatest({1}, 1) AS value, row_number() OVER (PARTITION BY {0} ORDER BY {2}) AS rank, count(*) OVER (PARTITION BY {0}) AS total FROM {3}) SELECT grp, rank, label, value FROM src WHERE rank <= 20 UNION ALL SELECT grp, 21, (max(total) - 20) || ' others', sum(value)::BIGINT FROM src WHERE rank > 20 GROUP BY grp"
_add("treemap_by_type", lambda c: treemap.by_type(c.s1), P + _TM.format("coalesce(package_type, 'unknown')", CL, BY, N1))
_add("treemap_by_depth", lambda c: treemap.by_depth(c.s1), P + _TM.format("coalesce(depth, 0)::VARCHAR", CL, BY, f"(SELECT * FROM {N1} WHERE coalesce(depth, 0) < 3)"))
_add("treemap_flat", lambda c: treemap.flat(c.s1), P + _TM.format("'all'", CL, BY, N1))
_LEV = """, lev1 AS (SELECT 1::BIGINT AS level, dependent AS parent, row_number() OVER (PARTITION BY dependent ORDER BY {2}) AS rank, id, label, greatest({1}, 1) AS value FROM (SELECT DISTINCT id AS dependent FROM {0}) JOIN (SELECT dependent, dependency FROM deps) USING (dependent) JOIN n ON n.id = dependency QUALIFY rank <= 20),
lev2 AS (SELECT 2::BIGINT AS level, dependent AS parent, row_number() OVER (PARTITION BY dependent ORDER BY {2}) AS rank, id, label, greatest({1}, 1) AS value FROM (SELECT DISTINCT id AS dependent FROM lev1) JOIN (SELECT dependent, dependency FROM deps) USING (dependent) JOIN n ON n.id = dependency QUALIFY rank <= 10)"""
_add("treemap_by_application", lambda c: treemap.by_application(c.s1), P + f", apps AS (SELECT 0::BIGINT AS level, 0::BIGINT AS parent, row_number() OVER (ORDER BY {BY}) AS rank, id, label, greatest({CL}, 1) AS value FROM {N1} WHERE is_top_level QUALIFY rank <= 20)" + _LEV.format("apps", CL, BY) + " SELECT * FROM apps UNION ALL SELECT * FROM lev1 UNION ALL SELECT * FROM lev2")
_add("treemap_remainder", lambda c: treemap.application_remainder(c.s1), P + f"SELECT count(*) AS others, coalesce(sum({CL}), 0)::BIGINT AS closure FROM (SELECT closure_size, row_number() OVER (ORDER BY {BY}) AS turn FROM {N1} WHERE is_top_level) WHERE turn > 20")
_add("treemap_from_node", lambda c: treemap.from_node(c.s1, ORDER), P + f", one AS (SELECT {ORDER}::BIGINT AS id)" + _LEV.format("one", CL, BY) + " SELECT * FROM lev1 UNION ALL SELECT * FROM lev2")
_add("treemap_node_info", lambda c: treemap.node_info(c.s1, PART), P + f"SELECT id, label, package_type, closure_size, (SELECT count(*) FROM deps WHERE dependent = {PART}) AS dependencies, (SELECT count(*) FROM deps WHERE dependency = {PART}) AS dependents FROM n WHERE id = {PART}")
_add("treemap_package_types", lambda c: treemap.package_types(c.g1), P + f"SELECT package_type, count(*) AS n FROM {N1} WHERE package_type IS NOT NULL GROUP BY 1")

# semantic zoom
_KIND = "coalesce(package_type, 'unknown')"
_add("zoom_level", lambda c: c.spark.createDataFrame([(s, zoom.level_of_scale(s)) for s in (0.1, 0.3, 0.5, 0.7, 1.0)], "scale double, level string"), "SELECT scale::DOUBLE AS scale, CASE WHEN scale < 0.3 THEN 'cluster' WHEN scale < 0.7 THEN 'overview' ELSE 'detailed' END AS level FROM (VALUES (0.1), (0.3), (0.5), (0.7), (1.0)) t(scale)")
_add("zoom_clusters", lambda c: zoom.cluster_nodes(c.s1), P + f", k AS (SELECT {_KIND} AS kind, label, {CL} AS s, row_number() OVER (PARTITION BY {_KIND} ORDER BY {BY}) AS turn FROM {N1}) SELECT kind, count(*) AS node_count, sum(s)::BIGINT AS total_closure, string_agg(label, ', ' ORDER BY turn) FILTER (turn <= 3) AS representatives FROM k GROUP BY 1")
_add("zoom_cluster_edges", lambda c: zoom.cluster_edges(c.g1), P + f"SELECT coalesce(s.package_type, 'unknown') AS source_kind, coalesce(t.package_type, 'unknown') AS target_kind, count(*) AS edges FROM {E1} JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE source_kind <> target_kind GROUP BY 1, 2")
_OV = f", ov AS (SELECT {_KIND} AS kind, row_number() OVER (PARTITION BY {_KIND} ORDER BY {BY}) AS rank, id, label FROM {N1} QUALIFY rank <= greatest(100 // (SELECT count(DISTINCT {_KIND}) FROM {N1}), 5))"
_add("zoom_overview", lambda c: zoom.overview_nodes(c.s1), P + _OV + " SELECT * FROM ov")
_add("zoom_overview_edges", lambda c: zoom.overview_edges(c.s1), P + _OV + f" SELECT source_id, target_id, dependency_type FROM {E1} WHERE source_id IN (SELECT id FROM ov) AND target_id IN (SELECT id FROM ov)")
_add("zoom_detailed", lambda c: zoom.detailed_nodes(c.g1, PART).select("id", "hops", "label"), P + f", u AS (SELECT source_id AS a, target_id AS b FROM {E1} UNION ALL SELECT target_id, source_id FROM {E1}), w(id, d) AS (SELECT {PART}::BIGINT, 0::BIGINT UNION SELECT b, d + 1 FROM w JOIN u ON a = w.id WHERE d < 2) SELECT id, min(d) AS hops, label FROM w JOIN nodes USING (id) GROUP BY id, label")
_PREFIX = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}') THEN regexp_extract(label, '{p}', 1)" for p in L.LABEL_PREFIXES) + " WHEN regexp_matches(label, '^.{3}.*[0-9]') THEN regexp_replace(regexp_extract(label, '^(.{3}[^0-9]*)[0-9]', 1), '[-_]+$', '') ELSE left(label, 15) END"
_DEPTH = "'depth-' || (coalesce(depth, 0) // 2 * 2)"
_GROUPED = ", g AS (SELECT *, {0} AS grp FROM " + N1 + "), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY " + BY + ") AS turn FROM g), big AS (SELECT grp FROM g GROUP BY 1 HAVING count(*) >= 5)"
_AGG_PREFIX = _GROUPED.format(_PREFIX)
for _name, _expr in (("prefix", _PREFIX), ("depth", _DEPTH)):
    _AGG = _GROUPED.format(_expr)
    _add(f"aggregate_by_{_name}", lambda c, n=_name: zoom.aggregates(c.s1, n), P + _AGG + f" SELECT grp, count(*) AS node_count, CASE WHEN count(DISTINCT {_KIND}) = 1 THEN min({_KIND}) ELSE 'mixed' END AS package_type, sum({CL})::BIGINT AS total_closure, round(avg(coalesce(depth, 0)), 6) AS avg_depth, string_agg(label, ', ' ORDER BY turn) FILTER (turn <= 3) AS largest FROM k WHERE grp IN (FROM big) GROUP BY 1")
    _add(f"aggregate_edges_by_{_name}", lambda c, n=_name: zoom.aggregate_edges(c.d1 if n == "depth" else c.g1, n), P + _AGG + f", pl AS (SELECT id, CASE WHEN grp IN (FROM big) THEN 'group:' || grp ELSE 'node:' || id END AS place FROM g) SELECT s.place AS source, t.place AS target, count(*) AS edges FROM {E1} JOIN pl s ON s.id = source_id JOIN pl t ON t.id = target_id WHERE s.place <> t.place GROUP BY 1, 2")
_add("label_prefix", lambda c: zoom._group_of(c.g1, "prefix").select("id", "grp"), P + f"SELECT id, {_PREFIX} AS grp FROM {N1}")
_add("expand_aggregate", lambda c: zoom.expanded(c.g1, "red-widget"), P + f"SELECT id, label FROM {N1} WHERE {_PREFIX} = 'red-widget'")

# dashboards and baselines
_DASH = f"SELECT (SELECT count(*) FROM {N1}) AS nodes, (SELECT count(*) FROM {N1} WHERE is_top_level) AS top_level, (SELECT max(depth) FROM {N1}) AS max_depth, (SELECT round(avg(depth), 6) FROM {N1}) AS avg_depth, (SELECT quantile_cont(depth, 0.5)::DOUBLE FROM {N1}) AS median_depth, count(*) AS edges, 0.0::DOUBLE AS redundancy, round(count(*) FILTER (dependency_type = 'runtime')::DOUBLE / count(dependency_type), 6) AS runtime_ratio FROM {E1}"
_add("dashboard_summary", lambda c: dashboard.summary(c.s1), P + _DASH)
_add("health_indicators", lambda c: dashboard.health(dashboard.summary(c.s1)), P + f", d AS ({_DASH}) SELECT redundancy, 'good' AS redundancy_health, avg_depth, CASE WHEN coalesce(avg_depth, 0) < 5 THEN 'good' WHEN avg_depth < 8 THEN 'warning' ELSE 'critical' END AS depth_health FROM d")
_add("top_contributors", lambda c: dashboard.top_contributors(c.s1), P + f"SELECT id, label, {CL} AS closure_size FROM {N1} ORDER BY {BY} LIMIT 10")
_add("top_level_contributors", lambda c: dashboard.top_contributors(c.s1, top_level_only=True), P + f"SELECT id, label, {CL} AS closure_size FROM {N1} WHERE is_top_level ORDER BY {BY} LIMIT 10")
_add("type_distribution", lambda c: dashboard.type_distribution(c.s1), P + f"SELECT {_KIND} AS kind, count(*) AS n, sum({CL})::BIGINT AS closure, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM {N1}), 6) AS percent FROM {N1} GROUP BY 1")
_BASE = ", bl AS (SELECT b AS baseline_id, name, sys AS is_system, made AS created_at, tags, (SELECT count(*) FROM nodes WHERE import_id = imp) AS node_count, (SELECT count(*) FROM edges WHERE import_id = imp) AS edge_count, (SELECT count(*) FROM nodes WHERE import_id = imp AND is_top_level) AS top_level_count, imp FROM (VALUES (1::BIGINT, 'first', TRUE, TIMESTAMP '2024-01-02', ['release', 'host'], 1), (2, 'second', FALSE, TIMESTAMP '2024-02-02', ['host'], 2), (3, 'third', FALSE, TIMESTAMP '2024-03-02', ['test'], 2)) t(b, name, sys, made, tags, imp))"
_add("create_baseline", lambda c: c.baselines.select("baseline_id", "name", "node_count", "edge_count", "top_level_count", "max_depth", F.size("top_contributors").cast("bigint").alias("contributors"), F.element_at("top_contributors", 1)["label"].alias("largest")), P + _BASE + f" SELECT baseline_id, name, node_count, edge_count, top_level_count, (SELECT max(depth) FROM n WHERE import_id = imp) AS max_depth, 10::BIGINT AS contributors, (SELECT label FROM n WHERE import_id = imp ORDER BY {BY} LIMIT 1) AS largest FROM bl")
_add("baseline_types", lambda c: c.baselines.select("baseline_id", F.explode("by_type").alias("kind", "n")), P + _BASE + f" SELECT baseline_id, {_KIND} AS kind, count(*) AS n FROM bl JOIN nodes ON import_id = imp GROUP BY 1, 2")
_add("baseline_by_name", lambda c: contribution.latest_only(c.baselines.where("name = 'second'"), ["name"], "created_at").select("baseline_id", "name"), "SELECT 2::BIGINT AS baseline_id, 'second' AS name")
_add("list_baselines", lambda c: dashboard.listed(c.baselines, tags=("host",)), P + _BASE + " SELECT baseline_id, name, node_count FROM bl WHERE list_has_any(tags, ['host'])")
_add("list_user_baselines", lambda c: dashboard.listed(c.baselines, include_system=False), P + _BASE + " SELECT baseline_id, name, node_count FROM bl WHERE NOT is_system")
_CMP = ", z AS (SELECT 'first' AS base_name, b.node_count - a.node_count AS nd, b.edge_count - a.edge_count AS ed, b.top_level_count - a.top_level_count AS td, 100.0::DOUBLE * (b.node_count - a.node_count) / a.node_count AS p FROM bl a, bl b WHERE a.baseline_id = 1 AND b.baseline_id = 2) SELECT base_name, nd AS node_difference, ed AS edge_difference, td AS top_level_difference, round(p, 6) AS percent, CASE WHEN p < 5 THEN 'minimal' WHEN p < 15 THEN 'moderate' WHEN p < 30 THEN 'significant' ELSE 'excessive' END AS growth, CASE WHEN nd = 0 THEN 'Same size as ' || base_name ELSE format('{:,}', abs(nd)) || CASE WHEN nd > 0 THEN ' more' ELSE ' fewer' END || ' packages than ' || base_name || ' (' || printf('%+.1f', p) || '%)' END AS summary FROM z"
_add("compare_to_baseline", lambda c: dashboard.compared(c.baselines.where("baseline_id = 2"), c.baselines.where("baseline_id = 1")), P + _BASE + _CMP)
_add("compare_to_previous", lambda c: dashboard.compared(dashboard.baseline(c.s2, 9, "now"), dashboard.baseline(c.s1, 8, "first")), P + _BASE + _CMP)
_add("compare_baseline_types", lambda c: dashboard.compared_types(c.baselines.where("baseline_id = 2"), c.baselines.where("baseline_id = 1")), P + f"SELECT {_KIND} AS kind, count(*) FILTER (import_id = 2) - count(*) FILTER (import_id = 1) AS difference FROM nodes WHERE import_id < 3 GROUP BY 1")
_add("dashboard_baseline", lambda c: dashboard.for_dashboard(c.baselines), "SELECT 1::BIGINT AS baseline_id, 'first' AS name")
_add("previous_imports", lambda c: dashboard.previous_imports(c.imports), P + "SELECT id, lag(id) OVER (PARTITION BY name ORDER BY imported_at, id) AS previous_id FROM imports")
_add("comparison_presets", lambda c: dashboard.presets(c.imports, c.baselines, 2), "SELECT * FROM (VALUES (1, 'previous', 1::BIGINT), (2, 'system', 1), (3, 'user', 2), (3, 'user', 3)) t(place, kind, ref)")
_add("imports_of_host", lambda c: dashboard.imports_of(c.imports, "host"), P + "SELECT id, name, config_path FROM imports WHERE name = 'host'")
_add("baseline_auto_name", lambda c: dashboard.auto_name(c.imports, "auto"), P + "SELECT id, name || ' - ' || strftime(imported_at, '%Y-%m-%d') || ' (auto)' AS baseline_name FROM imports")
_add("cache_candidates", lambda c: dashboard.cache_candidates(c.s1, "supplier|widget"), P + f", a AS (SELECT id, 1 AS pass FROM {N1} WHERE regexp_matches(label, '(?i)supplier|widget') ORDER BY {BY} LIMIT 10), b AS (SELECT id, 2 AS pass FROM {N1} ORDER BY {BY} LIMIT 20), u AS (SELECT id, min(pass) AS pass FROM (FROM a UNION ALL FROM b) GROUP BY 1) SELECT id, label, pass FROM u JOIN n USING (id) ORDER BY pass, {BY} LIMIT 20")
_add("cache_stats", lambda c: c.computed.groupBy("top_level_source").agg(F.count("*").alias("entries"), F.date_format(F.min("computed_at"), "yyyy-MM-dd").alias("oldest"), F.date_format(F.max("computed_at"), "yyyy-MM-dd").alias("newest")), P + _COMP + " SELECT top_level_source, count(*) AS entries, strftime(min(computed_at), '%Y-%m-%d') AS oldest, strftime(max(computed_at), '%Y-%m-%d') AS newest FROM comp GROUP BY 1")

# validation
_VE = f"SELECT 'edge_type_missing' AS check_name, 'error' AS severity, count(*) FILTER (dependency_type IS NULL) AS affected FROM {E1} UNION ALL SELECT 'edge_type_invalid', 'error', count(*) FILTER (dependency_type NOT IN ('build', 'runtime', 'unknown')) FROM {E1} UNION ALL SELECT 'edge_type_mostly_unknown', 'warning', CASE WHEN count(*) FILTER (dependency_type = 'unknown') > 0.5 * count(*) THEN count(*) FILTER (dependency_type = 'unknown') ELSE 0 END FROM {E1} UNION ALL SELECT 'edge_type_often_unknown', 'info', CASE WHEN count(*) FILTER (dependency_type = 'unknown') > 0.2 * count(*) AND count(*) FILTER (dependency_type = 'unknown') <= 0.5 * count(*) THEN count(*) FILTER (dependency_type = 'unknown') ELSE 0 END FROM {E1}"
_VT = f"SELECT 'no_top_level' AS check_name, 'warning' AS severity, CASE WHEN count(*) FILTER (is_top_level) = 0 THEN 1 ELSE 0 END::BIGINT AS affected FROM {N1} UNION ALL SELECT 'top_level_without_source', 'warning', count(*) FILTER (is_top_level AND top_level_source IS NULL) FROM {N1} UNION ALL SELECT 'source_without_top_level', 'error', count(*) FILTER (NOT is_top_level AND top_level_source IS NOT NULL) FROM {N1} UNION ALL SELECT 'source_distribution', 'info', count(DISTINCT top_level_source) FILTER (is_top_level) FROM {N1}"
_VC = "SELECT 'contribution_sum' AS check_name, 'error' AS severity, count(*) FILTER (total_contribution <> unique_contribution + shared_contribution) AS affected FROM contrib UNION ALL SELECT 'contribution_computed', 'info', count(*) FROM contrib"
_VD = f"SELECT 'self_edge' AS check_name, 'warning' AS severity, count(*) FILTER (source_id = target_id) AS affected FROM {E1} UNION ALL SELECT 'depth_coverage', 'warning', CASE WHEN count(depth) < 0.9 * count(*) THEN count(*) - count(depth) ELSE 0 END FROM {N1} UNION ALL SELECT 'closure_coverage', 'warning', CASE WHEN count(closure_size) < 0.9 * count(*) THEN count(*) - count(closure_size) ELSE 0 END FROM {N1}"
_ANY = "SELECT * FROM ({0}) WHERE affected > 0"
_add("validate_edges", lambda c: validate.edge_classification(c.g1), P + _ANY.format(_VE))
_add("validate_top_level", lambda c: validate.top_level_identification(c.g1), P + _ANY.format(_VT))
_add("validate_contributions", lambda c: validate.closure_contribution(c.contributions), P + _ANY.format(_VC))
_add("validate_references", lambda c: validate.referential_integrity(c.g1, c.raw.nodes), P + f"SELECT 'orphan_source' AS check_name, 'error' AS severity, count(*) AS affected FROM {E1} WHERE source_id NOT IN (SELECT id FROM nodes) HAVING affected > 0")
_add("validate_consistency", lambda c: validate.data_consistency(c.s1), P + _ANY.format(_VD))
_EVERY = " UNION ALL ".join([_VE, _VT, _VC, _VD])
_add("validate_import", lambda c: validate.everything(c.s1, c.raw.nodes, c.contributions), P + _ANY.format(_EVERY))
_add("validation_summary", lambda c: validate.verdict(validate.everything(c.s1, c.raw.nodes, c.contributions)), P + f", v AS ({_ANY.format(_EVERY)}) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS passed FROM v")
_add("validate_phase", lambda c: validate.phase_report(c.g1, c.contributions), "SELECT check_name, 'PASS' AS status, 0::BIGINT AS affected FROM (VALUES ('edge_classification'), ('self_edges'), ('top_level_source'), ('orphan_source'), ('contribution_sum'), ('contribution_sign')) t(check_name)")
