"""DuckDB SQL of how far forms can be relied on."""

from __future__ import annotations

from fieldweave.plans.form_sql import GROUPS

ROUTED = """
files AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS columns, c_custkey % 4 AS rows FROM customer WHERE c_nationkey % 5 <> 0),
zones AS (
  SELECT o_custkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'table' WHEN '2-HIGH' THEN 'form' WHEN '3-MEDIUM' THEN 'text' ELSE 'noise' END AS zone, round(least(o_totalprice / 400000, 1.0), 3) AS c FROM orders WHERE o_orderstatus <> 'P'
), best AS (
  SELECT f.*, max(c) FILTER (zone = 'table') AS best_table, max(c) FILTER (zone = 'form') AS best_form, max(c) FILTER (zone = 'text') AS best_text, max(c) FILTER (zone = 'noise') AS best_noise FROM files f LEFT JOIN zones USING (doc_id) GROUP BY ALL
), routed AS (
  SELECT doc_id, best_table IS NOT NULL AS has_table, best_form IS NOT NULL AS has_form, best_text IS NOT NULL AS has_text, best_noise IS NOT NULL AS has_noise, best_table, best_form, best_text, best_noise,
    coalesce(best_form < 0.65, false) AS low_form, coalesce(best_table >= 0.7, false) AND columns > 0 AND rows > 0 AND (best_form IS NULL OR best_table > best_form + 0.05) AS prefer_table
  FROM best
)"""

_list = lambda when: f"coalesce(array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR)) FILTER ({when})), ','), '')"

SQL = {
    "a18_zone_routing": f"WITH {ROUTED} SELECT * FROM routed",
    "a19_form_quality": f"""
WITH RECURSIVE {ROUTED}, {GROUPS}, named AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_totalprice > 250000 THEN 'ambiguous' WHEN o_totalprice > 200000 THEN 'weak_match' ELSE 'not_found' END AS status FROM orders
), fields AS (
  SELECT o_custkey AS doc_id, {_list("status = 'ambiguous'")} AS ambiguous, {_list("status = 'not_found'")} AS unresolved, {_list("o_orderpriority = '5-LOW'")} AS repaired, {_list("o_orderpriority = '4-NOT SPECIFIED'")} AS blocked, {_list("o_orderpriority = '1-URGENT' AND status NOT IN ('resolved', 'weak_match')")} AS critical
  FROM named GROUP BY o_custkey
), counted AS (SELECT doc_id, count(*) AS groups FROM every GROUP BY doc_id),
whole AS (
  SELECT c_custkey AS doc_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'legacy_fallback' WHEN 'MACHINERY' THEN 'repair_model' ELSE 'form_resolver' END AS mode, c_custkey % 7 AS targets, c_custkey % 3 AS resolved, coalesce(groups, 0) AS groups,
    coalesce(ambiguous, '') AS ambiguous, coalesce(unresolved, '') AS unresolved, coalesce(repaired, '') AS repaired, coalesce(blocked, '') AS blocked, coalesce(critical, '') AS critical,
    coalesce((SELECT array_to_string(list_sort(list('group_' || t || '_' || g)), ',') FROM every e WHERE e.doc_id = c_custkey AND len(list_filter(options, lambda o: o.selected)) > 1 AND contains(question, 'только')), '') AS torn,
    coalesce(prefer_table, false) AS prefer, coalesce(has_form AND low_form, false) AS low
  FROM customer LEFT JOIN fields f ON f.doc_id = c_custkey LEFT JOIN counted n ON n.doc_id = c_custkey LEFT JOIN routed r ON r.doc_id = c_custkey
), flagged AS (
  SELECT * EXCLUDE (prefer, low), array_to_string(list_filter([CASE WHEN critical <> '' THEN 'critical_unresolved' END, CASE WHEN ambiguous <> '' THEN 'ambiguous_fields' END, CASE WHEN torn <> '' THEN 'single_choice_multi_select' END, CASE WHEN mode = 'legacy_fallback' THEN 'legacy_fallback_used' END,
    CASE WHEN resolved = 0 AND targets > 0 THEN 'empty_normalized_row' END, CASE WHEN targets >= 3 AND resolved <= greatest(targets // 3, 1) THEN 'low_field_coverage' END, CASE WHEN prefer THEN 'pdf_zone_prefers_table' WHEN low THEN 'low_confidence_form_zones' END], lambda x: x IS NOT NULL), ',') AS flags FROM whole
)
SELECT *, flags <> '' AS needs_attention, flags <> '' AND mode <> 'repair_model' AS repair_recommended FROM flagged
""",
}
