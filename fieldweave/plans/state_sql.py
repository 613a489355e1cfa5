"""DuckDB SQL of runs and their states."""

from __future__ import annotations

SUGGESTED = """
lines AS (
  SELECT l_orderkey AS run_id, l_linenumber AS line, l_suppkey % 50 AS user_id, CASE WHEN l_linenumber <> 4 THEN 'order Part' || l_partkey % 9 END AS source, CASE WHEN l_linenumber <> 4 THEN 'orderpart' || l_partkey % 9 END AS source_name,
    'target_' || l_linenumber AS target, 'target' || l_linenumber AS target_name, CASE WHEN l_quantity > 30 THEN 'high' WHEN l_quantity > 10 THEN 'medium' WHEN l_quantity > 5 THEN 'low' ELSE 'none' END AS band,
    CASE WHEN l_extendedprice < 3000 THEN 'rejected' WHEN l_linestatus = 'O' THEN 'accepted' END AS given, CASE WHEN l_returnflag <> 'N' THEN 'deterministic_rule' END AS known
  FROM lineitem WHERE l_linenumber <> 6
), suggested AS (SELECT *, coalesce(given, CASE WHEN band IN ('high', 'medium') THEN 'accepted' ELSE 'suggested' END) AS status, coalesce(known, 'model_suggestion') AS truth FROM lines)"""

PROMOTED = f"""
{SUGGESTED}, runs AS (SELECT o_orderkey AS run_id, o_custkey % 4 AS warnings, o_orderpriority AS p FROM orders),
states AS (SELECT run_id, bool_or(status = 'rejected') AS rejected, bool_or(status = 'suggested' AND source IS NOT NULL) AS waits FROM suggested JOIN runs USING (run_id) WHERE p <> '5-LOW' GROUP BY run_id),
sure AS (SELECT run_id, bool_and(source IS NOT NULL AND coalesce(given, 'accepted') = 'accepted' AND known IS NOT NULL OR source IS NOT NULL AND coalesce(given, 'accepted') = 'accepted' AND known IS NULL) AS ok FROM lines GROUP BY run_id),
means AS (SELECT run_id, avg(CASE band WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.0 END) AS mean FROM lines GROUP BY run_id),
asked AS (SELECT run_id FROM runs UNION SELECT -c_custkey - 1 FROM customer UNION SELECT NULL),
told AS (
  SELECT a.run_id, r.warnings, mean, CASE WHEN a.run_id IS NULL THEN 'missing_generation_id' WHEN r.run_id IS NULL THEN 'generation_not_found' WHEN p = '1-URGENT' THEN 'already_promoted' WHEN rejected THEN 'has_rejected_suggestions' WHEN waits THEN 'has_pending_suggestions'
    WHEN s.run_id IS NULL AND NOT coalesce(ok, false) THEN 'generation_not_confirmed' END AS reason
  FROM asked a LEFT JOIN runs r ON r.run_id = a.run_id LEFT JOIN states s ON s.run_id = a.run_id LEFT JOIN sure u ON u.run_id = a.run_id LEFT JOIN means m ON m.run_id = a.run_id
), promoted AS (SELECT run_id, coalesce(reason = 'already_promoted', true) AS promoted, reason, CASE WHEN reason IS NULL THEN round(greatest(0.0, least(1.0, coalesce(mean, 0) - least(0.08 * warnings, 0.35))), 6) END::DOUBLE AS quality FROM told)"""

SQL = {
    "m30_suggestions": f"""
WITH {SUGGESTED} SELECT run_id, line, user_id, source, source_name, target, target_name, CASE band WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 END::DOUBLE AS confidence, status, truth FROM suggested
""",
    "m31_promotion": f"WITH {PROMOTED} SELECT * FROM promoted",
    "m31_learned": f"""
WITH {PROMOTED}, new AS (SELECT * FROM promoted WHERE promoted AND reason IS NULL),
mapped AS (SELECT run_id, source, target, status FROM suggested JOIN runs USING (run_id) WHERE p <> '5-LOW' UNION ALL SELECT run_id, source, ' ' || target, coalesce(given, 'accepted') FROM lines JOIN runs USING (run_id) WHERE p = '5-LOW'),
entries AS (SELECT DISTINCT run_id, source, target FROM mapped WHERE source IS NOT NULL AND status = 'accepted' AND run_id IN (SELECT run_id FROM new))
SELECT 'accepted_generation' AS kind, count(*) AS n, count(DISTINCT run_id) AS runs FROM entries
UNION ALL
SELECT CASE WHEN quality >= 0.92 THEN 'approved ' ELSE 'candidate ' END || CASE WHEN quality >= 0.85 THEN 'train' ELSE 'validation' END, count(*), count(*) FROM new WHERE quality >= 0.72 GROUP BY 1
""",
    "m45_versions": """
SELECT o_orderkey AS run_id, o_custkey % 5 + 1 + CASE WHEN changed THEN 1 ELSE 0 END AS version, CASE WHEN changed THEN o_custkey % 5 + 1 END AS parent, changed AS updated
FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 6) AS changed FROM orders)
""",
    "m46_patches": """
WITH last AS (SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' GROUP BY 1, 2),
fixes AS (SELECT o_custkey AS run_id, string_agg(o_orderpriority || '=' || value, ',' ORDER BY o_orderpriority || '=' || value) AS fixes FROM last GROUP BY 1)
SELECT run_id, max(o_orderkey) + 1 AS version, max(o_orderkey) AS parent, any_value(fixes) AS fixes FROM fixes JOIN orders ON o_custkey = run_id GROUP BY run_id
""",
}
