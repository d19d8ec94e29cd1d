"""The SQL side of the checks: the same graph from the same tables, as common table expressions."""

from __future__ import annotations

from ..functions import labels as L
from ..sources.graph import IMPORTS, PART_TYPES


def case(column: str, table: list[tuple[str, list[str]]], otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{L.one_of(p)}') THEN '{name}'" for name, p in table)
    return f"CASE {whens} ELSE {otherwise} END"


def module_type(column: str) -> str:
    return f"CASE WHEN {column} IN ('systemPackages', 'environment.systemPackages') THEN 'systemPackages' WHEN starts_with({column}, 'programs.') THEN 'programs' WHEN starts_with({column}, 'services.') THEN 'services' ELSE 'other' END"


_PART_TYPE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_TYPES.items())
_IMPORTS = ", ".join(f"({i}::BIGINT, '{name}', '{path}', TIMESTAMP '{at}')" for i, name, path, at in IMPORTS)

PRELUDE = f"""
WITH RECURSIVE imports(id, name, config_path, imported_at) AS (VALUES {_IMPORTS}),
raw_nodes AS (
  SELECT 1 AS kind, r_regionkey::BIGINT AS key, r_name AS label, 'bootstrap' AS package_type FROM region
  UNION ALL SELECT 2, n_nationkey, n_name, 'configuration' FROM nation
  UNION ALL SELECT 3, s_suppkey, s_name, 'service' FROM supplier
  UNION ALL SELECT 4, p_partkey, replace(p_name, ' ', '-') || '-' || (p_size % 4) || '.' || (p_partkey % 3), CASE p_type {_PART_TYPE} END FROM part
  UNION ALL SELECT 5, c_custkey, c_name, 'library' FROM customer
  UNION ALL SELECT 6, o_orderkey, 'order-' || o_orderkey, 'application' FROM orders
), top_raw AS (
  SELECT 6 AS kind, o_orderkey AS key, CASE o_orderpriority WHEN '1-URGENT' THEN 'systemPackages' WHEN '2-HIGH' THEN 'programs.' || o_orderkey || '.enable'
    WHEN '3-MEDIUM' THEN 'services.' || o_orderkey || '.enable' ELSE 'custom' END AS src FROM orders WHERE o_orderkey % 50 = 0
), nodes AS (
  SELECT kind::BIGINT * 1000000000 + key + CASE WHEN i.id = 2 THEN 100000000000 ELSE 0 END AS id, i.id AS import_id,
    md5(kind || ':' || key || CASE WHEN i.id = 2 AND key % 5 = 0 THEN ':2' ELSE '' END) AS drv_hash, label || '.drv' AS drv_name, label, package_type,
    t.src IS NOT NULL AS is_top_level, t.src AS top_level_source, CASE WHEN t.src IS NOT NULL THEN {module_type('t.src')} END AS module_type
  FROM raw_nodes LEFT JOIN top_raw t USING (kind, key) CROSS JOIN imports i WHERE i.id = 1 OR (i.id = 2 AND NOT (kind IN (4, 6) AND key % 7 = 0))
  UNION ALL
  SELECT 7000000000 + p_partkey, 3, md5('7:' || p_partkey), 'cyc-' || p_partkey || '.drv', 'cyc-' || p_partkey, 'library', FALSE, NULL, NULL FROM part
), first_supplier AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
base_edges AS (
  SELECT 1000000000 + n_regionkey AS source_id, 2000000000 + n_nationkey AS target_id, 'runtime' AS dependency_type FROM nation
  UNION ALL SELECT 2000000000 + s_nationkey, 3000000000 + s_suppkey, 'runtime' FROM supplier
  UNION ALL SELECT 2000000000 + c_nationkey, 5000000000 + c_custkey, 'runtime' FROM customer
  UNION ALL SELECT 3000000000 + s, 4000000000 + l_partkey, 'build' FROM first_supplier
  UNION ALL SELECT 4000000000 + l_partkey, 6000000000 + l_orderkey, CASE min(l_returnflag) WHEN 'R' THEN 'build' WHEN 'A' THEN 'unknown' ELSE 'runtime' END FROM lineitem GROUP BY l_partkey, l_orderkey
  UNION ALL SELECT 5000000000 + o_custkey, 6000000000 + o_orderkey, 'runtime' FROM orders
  UNION ALL SELECT 2000000000 + s_nationkey, 4000000000 + l_partkey, 'build' FROM first_supplier JOIN supplier ON s = s_suppkey WHERE l_partkey % 10 = 0
), last_part AS (SELECT max(p_partkey) AS last FROM part),
edges AS (
  SELECT 1::BIGINT AS import_id, source_id, target_id, dependency_type FROM base_edges
  UNION ALL SELECT 2, source_id + 100000000000, target_id + 100000000000, dependency_type FROM base_edges
    WHERE NOT (source_id // 1000000000 IN (4, 6) AND source_id % 1000000000 % 7 = 0) AND NOT (target_id // 1000000000 IN (4, 6) AND target_id % 1000000000 % 7 = 0)
  UNION ALL SELECT 3, 7000000000 + p_partkey, 7000000000 + CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END, 'runtime' FROM part, last_part
    WHERE NOT (p_partkey % 5 = 4 AND (p_partkey // 5) % 3 = 0) AND (p_partkey // 5) * 5 + 4 <= last
  UNION ALL SELECT 3, 7000000000 + p_partkey, 7000000000 + p_partkey + 5, 'runtime' FROM part, last_part WHERE p_partkey % 10 = 0 AND p_partkey + 5 <= last
), deps AS (SELECT import_id, target_id AS dependent, source_id AS dependency, dependency_type AS dep_type FROM edges),
closure(import_id, node, dep) AS (
  SELECT import_id, dependent, dependency FROM deps
  UNION SELECT c.import_id, c.node, d.dependency FROM closure c JOIN deps d ON d.dependent = c.dep
), closure_sizes AS (SELECT node, count(*) AS closure_size FROM closure GROUP BY 1),
roots AS (
  SELECT import_id, source_id AS root FROM (SELECT import_id, source_id, row_number() OVER (PARTITION BY import_id ORDER BY count(*) DESC, source_id) AS turn FROM edges GROUP BY 1, 2) WHERE turn = 1
), walk(import_id, id, depth) AS (
  SELECT import_id, root, 0::BIGINT FROM roots
  UNION SELECT w.import_id, d.dependency, w.depth + 1 FROM walk w JOIN deps d ON d.dependent = w.id WHERE w.depth < 30
), depths AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1),
n AS (
  SELECT nodes.*, depths.depth, closure_sizes.closure_size FROM nodes LEFT JOIN depths USING (id) LEFT JOIN closure_sizes ON closure_sizes.node = nodes.id
), top_closure AS (SELECT c.node AS top_id, c.dep FROM closure c JOIN nodes t ON t.id = c.node AND t.is_top_level WHERE c.import_id = 1),
usage AS (SELECT dep, count(*) AS users FROM top_closure GROUP BY 1),
contrib AS (
  SELECT top_id AS id, label, package_type, count(*) FILTER (users = 1) AS unique_contribution, count(*) FILTER (users > 1) AS shared_contribution, count(*) AS total_contribution
  FROM top_closure JOIN usage USING (dep) JOIN nodes ON nodes.id = top_id GROUP BY ALL
), degrees AS (SELECT source_id AS id, count(*) AS dependents FROM edges GROUP BY 1)
"""
