"""More named queries: drawings, filtered treemaps and flows, orders of variants, and the whole answer to why a node is there."""

from __future__ import annotations

from ..operators import drawing, treemap, variants, why, zoom
from .catalog import BY, CL, E1, LABEL, N1, ORDER, PART, SUPPLIER, Context, P, _add
from .catalog_more import _AGG_PREFIX, _ALL, _ESS, _GROUPS, _GTOP, _KIND, _LEV, _OV, _PATHS, _PS, _TM


# drawings
def _colour(kind: str) -> str:
    return f"""CASE {kind} WHEN 'service' THEN '#69db7c' WHEN 'library' THEN '#74c0fc' WHEN 'development' THEN '#b197fc' WHEN 'bootstrap' THEN '#f783ac' WHEN 'configuration' THEN '#ffd43b'
    WHEN 'python-package' THEN '#3b82f6' WHEN 'font' THEN '#ec4899' WHEN 'application' THEN '#22d3ee' WHEN 'mixed' THEN '#a1a1aa' ELSE '#e2e8f0' END"""


def _short(label: str) -> str:
    return f"CASE WHEN length({label}) > 30 THEN {label}[:30] || '...' ELSE {label} END"


def _drawn(label: str, kind: str, more: str = "") -> str:
    return f"""'n' || id || ' [label="' || {label} || '", fillcolor="' || {_colour(kind)} || '"{more}];'"""


_add(
    "cluster_drawing",
    lambda c: drawing.cluster_drawing(c.s1),
    P + f""", k AS (SELECT coalesce(s.package_type, 'unknown') AS a, coalesce(t.package_type, 'unknown') AS b, count(*) AS n FROM {E1} JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id GROUP BY 1, 2),
    w AS (SELECT a, b, n, least(10 + (n + 5) // 10, 50) AS w FROM k WHERE a <> b)
    SELECT 'nodes' AS part, '"' || {_KIND} || '" [label="' || {_KIND} || '\\n(' || count(*) || ' packages)", fillcolor="' || {_colour(_KIND)} || '"];' AS statement FROM {N1} GROUP BY {_KIND}
    UNION ALL SELECT 'edges', '"' || a || '" -> "' || b || '" [penwidth=' || (w // 10) || '.' || (w % 10) || ', tooltip="' || n || ' edges"];' FROM w""",
)
_add(
    "node_drawing",
    lambda c: drawing.node_drawing(c.s1, PART),
    P + f""", u AS (SELECT n.* FROM n WHERE id IN (SELECT dependent FROM deps WHERE dependency = {PART}) ORDER BY {BY} LIMIT 20), d AS (SELECT n.* FROM n WHERE id IN (SELECT dependency FROM deps WHERE dependent = {PART}) ORDER BY {BY} LIMIT 20)
    SELECT 'dependents' AS part, {_drawn(_short('label'), 'package_type')} AS statement FROM u UNION ALL SELECT 'node', {_drawn('label', 'package_type', ', penwidth=3')} FROM n WHERE id = {PART}
    UNION ALL SELECT 'dependencies', {_drawn(_short('label'), 'package_type')} FROM d UNION ALL SELECT 'edges', 'n' || id || ' -> n{PART};' FROM u UNION ALL SELECT 'edges', 'n{PART} -> n' || id || ';' FROM d""",
)
_add(
    "overview_drawing",
    lambda c: drawing.overview_drawing(c.s1),
    P + _OV + f""" SELECT 'cluster_' || replace(kind, '-', '_') AS part, {_drawn(_short('label'), 'kind')} AS statement FROM ov
    UNION ALL SELECT 'edges', 'n' || source_id || ' -> n' || target_id || ';' FROM {E1} WHERE source_id IN (SELECT id FROM ov) AND target_id IN (SELECT id FROM ov)""",
)
_add(
    "aggregate_drawing",
    lambda c: drawing.aggregate_drawing(c.s1),
    P + _AGG_PREFIX + f""" SELECT 'aggregates' AS part, '"group:' || grp || '" [label="' || grp || '*\\n(' || count(*) || ' packages)", shape=hexagon, fillcolor="' ||
    CASE WHEN count(DISTINCT {_KIND}) = 1 THEN {_colour(f'min({_KIND})')} ELSE '#a1a1aa' END || '", tooltip="' || string_agg(label, ', ' ORDER BY turn) FILTER (turn <= 3) || '"];' AS statement FROM k WHERE grp IN (FROM big) GROUP BY grp""",
)

# what a zoom level shows
_SEEN = f"""SELECT 'node' AS part, id::VARCHAR AS source, NULL::VARCHAR AS target, 1::BIGINT AS count FROM {{0}}
    UNION ALL SELECT 'edge', source_id::VARCHAR, target_id::VARCHAR, 1 FROM {E1} WHERE source_id IN (SELECT id FROM {{0}}) AND target_id IN (SELECT id FROM {{0}})"""
_add(
    "semantic_graph_clusters",
    lambda c: zoom.semantic_graph(c.s1, 0.1),
    P + f"""SELECT 'node' AS part, {_KIND} AS source, NULL::VARCHAR AS target, count(*) AS count FROM {N1} GROUP BY {_KIND}
    UNION ALL SELECT * FROM (SELECT 'edge', coalesce(s.package_type, 'unknown') AS a, coalesce(t.package_type, 'unknown') AS b, count(*) FROM {E1} JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id GROUP BY 2, 3) WHERE a <> b""",
)
_add("semantic_graph_overview", lambda c: zoom.semantic_graph(c.s1, 0.5), P + _OV + " " + _SEEN.format("ov"))
_add(
    "semantic_graph_details",
    lambda c: zoom.semantic_graph(c.s1, 1.0, PART, 60),
    P + f""", u AS (SELECT source_id AS a, target_id AS b FROM {E1} UNION ALL SELECT target_id, source_id FROM {E1}), w(id, d) AS (SELECT {PART}::BIGINT, 0 UNION SELECT b, d + 1 FROM w JOIN u ON a = w.id WHERE d < 2),
    seen AS (SELECT id FROM w JOIN nodes USING (id) GROUP BY id, label ORDER BY min(d), label, id LIMIT 60) """ + _SEEN.format("seen"),
)
_add(
    "zoom_info",
    lambda c: zoom.zoom_info(c.s1),
    P + _OV + _AGG_PREFIX + f""" SELECT 'cluster' AS level, count(DISTINCT {_KIND}) AS shown FROM {N1} UNION ALL SELECT 'overview', count(*) FROM ov UNION ALL SELECT 'detailed', count(*) FROM {N1} UNION ALL SELECT 'aggregate', count(*) FROM big""",
)

# treemaps by mode and filter
_add("treemap_type_filtered", lambda c: treemap.treemap(c.s1, "type", "type:library"), P + _TM.format("package_type", CL, BY, f"(SELECT * FROM {N1} WHERE package_type = 'library')"))
_ONE = f", one AS (SELECT {ORDER}::BIGINT AS id)"
_HEAD = f" SELECT 0::BIGINT AS level, 0::BIGINT AS parent, 1 AS rank, id, label, greatest({CL}, 1) AS value FROM n WHERE id = {ORDER} UNION ALL SELECT * FROM lev1 UNION ALL SELECT * FROM lev2"
_DEPS = "(SELECT dependent, dependency FROM deps)"
_add("treemap_root_runtime", lambda c: treemap.treemap(c.s1, filter_type="runtime", root=ORDER, levels=2), P + _ONE + _LEV.replace(_DEPS, "(SELECT dependent, dependency FROM deps WHERE dep_type = 'runtime')").format("one", CL, BY) + _HEAD)
_add("treemap_root_of_type", lambda c: treemap.treemap(c.s1, filter_type="type:library", root=ORDER, levels=2), P + _ONE + _LEV.replace("JOIN n ON n.id = dependency", "JOIN n ON n.id = dependency AND package_type = 'library'").format("one", CL, BY) + _HEAD)
_add("treemap_not_found", lambda c: treemap.treemap(c.s1, root=-1, levels=1).drop("id"), "SELECT 0::BIGINT AS level, 0::BIGINT AS parent, 1 AS rank, 'Not Found' AS label, 0::BIGINT AS value")


# flows from packages to the variants of a label
def _flow_sql(most: int, each: int, app: str | None) -> str:
    only = "" if app is None else f" WHERE tl = {app}"
    return P + _ALL + f""", e AS (SELECT each.*, coalesce(via, v) AS grp FROM each), g AS (SELECT v, grp, count(*) AS total, bool_or(via IS NULL) AS direct FROM e GROUP BY 1, 2),
    gk AS (SELECT g.*, row_number() OVER (PARTITION BY v ORDER BY total DESC, direct DESC, label, grp) AS place FROM g JOIN nodes ON nodes.id = grp),
    ek AS (SELECT e.*, total, label AS tl, row_number() OVER (PARTITION BY e.v, e.grp ORDER BY lower(label), label, top_id) AS turn FROM e JOIN gk ON gk.v = e.v AND gk.grp = e.grp AND place <= {most} JOIN nodes ON nodes.id = top_id),
    s AS (SELECT * FROM (SELECT * FROM ek WHERE turn <= {each}){only}), links AS (SELECT top_id AS source, grp AS target, 1 AS value FROM s UNION ALL SELECT via, v, {'max(total)' if app is None else 'count(*)'} FROM s WHERE via IS NOT NULL GROUP BY 1, 2)
    SELECT source, target, sum(value)::BIGINT AS value FROM links GROUP BY 1, 2"""


_FIRST_APP = f"(SELECT label FROM (WITH RECURSIVE w(id) AS (SELECT id FROM {N1} WHERE label = {LABEL} UNION SELECT dependent FROM w JOIN deps ON dependency = w.id) SELECT label, min(id), arg_min({CL}, id) AS size FROM n JOIN w USING (id) WHERE is_top_level GROUP BY label ORDER BY size DESC, label LIMIT 1))"


def _app_flow(c: Context):
    first = why.top_level_apps(c.s1, c.label, 1).first()
    return why.sankey(c.g1, c.label, max_top_level=20, max_intermediate=10, app=first["label"] if first else "")


_add("sankey_largest", lambda c: why.sankey(c.g1, c.label, max_top_level=2, max_intermediate=3), _flow_sql(3, 2, None))
_add("sankey_of_app", _app_flow, _flow_sql(10, 20, _FIRST_APP))

# variants in order
for _by, _first in (("dependent_count", "dependents DESC, "), ("hash", ""), ("closure_size", "size DESC, ")):
    _add(
        f"variants_by_{_by}",
        lambda c, by=_by: variants.variant_order(c.s1 if by == "closure_size" else c.unsized[0], c.label, by),
        P + f", k AS (SELECT v.id, v.drv_hash, {CL} AS size, count(DISTINCT dependent) AS dependents FROM {N1} v LEFT JOIN deps ON dependency = v.id WHERE label = {LABEL} GROUP BY ALL) SELECT id, drv_hash, dependents, row_number() OVER (ORDER BY {_first}drv_hash, id) AS rank FROM k QUALIFY rank <= 20",
    )

# the whole answer to why a node is there, and its exports
_CHAIN = """, chain AS (SELECT id, label, drv_hash, package_type, (SELECT count(DISTINCT top_id) FROM paths) AS total_top_level_dependents, (SELECT count(*) FROM paths) AS total_paths_found,
(SELECT count(DISTINCT dependent) FROM deps WHERE dependency = {0}) AS direct_dependents, (SELECT status FROM ess) AS essentiality FROM nodes WHERE id = {0})"""
_add(
    "why_chain",
    lambda c: why.why_chain(c.g1, SUPPLIER, c.paths),
    _PS + _ESS + _GROUPS + _CHAIN.format(SUPPLIER) + f" SELECT chain.*, coalesce((SELECT string_agg(via_label, ', ' ORDER BY total_dependents DESC, shortest > 1, via_label, via) FROM ({_GTOP})), '') AS via FROM chain",
)
_EXPORT = _ESS + _GROUPS.replace("turn <= 5", "turn <= 10") + _CHAIN + f""", best AS (SELECT CASE WHEN length <= 1 THEN path[-1] ELSE path[-2] END AS via, arg_min(path, (length, path)) AS path FROM paths GROUP BY 1),
sp AS (SELECT via, string_agg(label, ' -> ' ORDER BY place) AS text, count(*) - 1 AS n, bool_or(coalesce(package_type = 'build', FALSE)) AS built FROM (SELECT via, unnest(path) AS id, generate_subscripts(path, 1) AS place FROM best) JOIN nodes USING (id) GROUP BY via),
x AS (SELECT chain.label AS target_package, chain.drv_hash[:12] AS target_hash, essentiality AS essentiality_status, total_top_level_dependents, coalesce(via_label, '(no attribution paths)') AS via_package, coalesce(via::VARCHAR, '') AS via_node_id,
coalesce(total_dependents, 0) AS group_dependent_count, coalesce(top_level_packages || CASE WHEN total_dependents > 10 THEN ' (+' || (total_dependents - 10) || ' more)' ELSE '' END, '') AS top_level_packages,
coalesce(text, '') AS shortest_path, coalesce(sp.n, 0) AS shortest_path_length, CASE WHEN via IS NULL THEN '' WHEN built THEN 'no' ELSE 'yes' END AS is_runtime_path FROM chain LEFT JOIN ({_GTOP}) g ON TRUE LEFT JOIN sp USING (via))"""
_add("attribution_export", lambda c: why.attribution_export(c.g1, SUPPLIER, c.paths), _PS + _EXPORT.format(SUPPLIER) + " SELECT * FROM x")
_LEAF = ORDER + 1  # an order that is not top-level: no path leads to it
_add("attribution_export_empty", lambda c: why.attribution_export(c.g1, _LEAF, why.attribution_paths(c.g1, _LEAF, max_paths=None)), P + _PATHS.format(_LEAF) + _EXPORT.format(_LEAF) + " SELECT * FROM x")
_add(
    "attribution_markdown",
    lambda c: why.attribution_markdown(why.attribution_export(c.g1, SUPPLIER, c.paths)).select("line"),
    _PS + _EXPORT.format(SUPPLIER) + """ SELECT DISTINCT '# Why ' || target_package || '? (' || essentiality_status || ', ' || total_top_level_dependents || ' top-level packages)' AS line FROM x
    UNION ALL SELECT '- **' || via_package || '**: ' || group_dependent_count || CASE WHEN shortest_path <> '' THEN ', `' || shortest_path || '`' ELSE '' END FROM x""",
)
