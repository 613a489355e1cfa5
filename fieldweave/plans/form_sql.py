"""DuckDB SQL of forms: groups by walking rows one by one, and what their rows say from how they were made."""

from __future__ import annotations

#: rows as they are told apart: kind, text of a question or note, options
ROWS = """
rows AS (
  SELECT o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS t, o_orderkey AS row,
    CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_totalprice > 200000 THEN 'question' ELSE 'scalar' END WHEN '2-HIGH' THEN 'question' WHEN '3-MEDIUM' THEN 'option' WHEN '5-LOW' THEN 'inline' ELSE 'text' END AS kind,
    CASE o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o_totalprice > 200000 THEN 'СВЕДЕНИЯ О ЗАКАЗЕ ЮРИДИЧЕСКОМ ЛИЦЕ БЕЗ' ELSE CAST(o_orderkey AS VARCHAR) END
      WHEN '2-HIGH' THEN 'Is sale ' || o_orderkey || ' delivered to the client?' WHEN '3-MEDIUM' THEN 'paid in part ' || o_orderkey WHEN '5-LOW' THEN 'Which of the parts apply to the sale?' ELSE 'see note' END AS text,
    o_orderstatus = 'F' AS marked, CASE o_orderstatus WHEN 'F' THEN 'X' WHEN 'O' THEN '☐' ELSE 'l' END AS marker, row_number() OVER (PARTITION BY o_custkey, t ORDER BY o_orderkey) AS n
  FROM orders
)"""

#: opened: 0 no group, 1 one without options, 2 one with options
GROUPS = f"""
{ROWS}, walk AS (
  SELECT doc_id, t, n, row, kind, text, marked, marker, CASE kind WHEN 'question' THEN 1 WHEN 'option' THEN 2 ELSE 0 END AS opened, row AS g,
    CASE kind WHEN 'question' THEN text WHEN 'option' THEN 'Unknown question' END AS question FROM rows WHERE n = 1
  UNION ALL
  SELECT r.doc_id, r.t, r.n, r.row, r.kind, r.text, r.marked, r.marker,
    CASE r.kind WHEN 'question' THEN 1 WHEN 'option' THEN 2 WHEN 'inline' THEN 0 WHEN 'scalar' THEN CASE WHEN w.opened = 2 THEN 0 ELSE w.opened END ELSE w.opened END,
    CASE WHEN r.kind = 'question' OR r.kind = 'option' AND w.opened = 0 THEN r.row ELSE w.g END,
    CASE WHEN r.kind = 'question' THEN r.text WHEN r.kind = 'option' AND w.opened = 0 THEN 'Unknown question' WHEN r.kind = 'text' AND w.opened = 1 THEN w.question || ' ' || r.text ELSE w.question END
  FROM walk w JOIN rows r ON r.doc_id = w.doc_id AND r.t = w.t AND r.n = w.n + 1
), runs AS (
  SELECT doc_id, t, g, any_value(question) AS question, list({{'label': text, 'selected': marker <> '☐', 'marker': marker}} ORDER BY row) AS options, list(row) AS places FROM walk WHERE kind = 'option' GROUP BY doc_id, t, g
), inline AS (
  SELECT doc_id, t, row, text,
    CASE WHEN marked THEN [{{'label': 'first ' || row, 'selected': true, 'marker': 'X'}}, {{'label': 'second', 'selected': false, 'marker': ''}}] ELSE [{{'label': 'first ' || row || '; second', 'selected': true, 'marker': 'X'}}] END, [row]
  FROM rows WHERE kind = 'inline'
), every AS (
  SELECT *, doc_id || ' ' || lower(question) || ' ' || array_to_string(list_transform(options, lambda o: lower(replace(o.label, ';', ''))), ' / ') AS same FROM (SELECT * FROM runs UNION ALL SELECT * FROM inline)
), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY same ORDER BY t, g) = 1)"""

SQL = {
    "l9_table_groups": f"""
WITH RECURSIVE {GROUPS}, scored AS (SELECT *, len(list_filter(options, lambda o: o.selected)) AS chosen FROM once)
SELECT doc_id, t * 1000000 + g AS pos, 'group_' || t || '_' || g AS group_id, question, CASE WHEN chosen > 1 THEN 'multi_choice' ELSE 'single_choice' END AS group_type,
  array_to_string(list_transform(options, lambda o: o.label || '|' || o.selected || '|' || o.marker), '; ') AS options,
  CAST(0.8 + CASE WHEN len(options) >= 2 THEN 0.15 ELSE 0 END AS DOUBLE) AS group_score, CAST(CASE WHEN chosen = 1 THEN 0.95 WHEN chosen > 1 THEN 0.25 ELSE 0.35 END AS DOUBLE) AS choice_score, false AS ambiguous
FROM scored
""",
    "l9_table_scalars": f"""
WITH {ROWS} SELECT doc_id, t * 1000000 + row AS pos, 'Key of sale' AS label, text AS value, 'medium' AS confidence, CAST(0.88 AS DOUBLE) AS score FROM rows WHERE kind = 'scalar'
""",
    "l10_line_scalars": """
SELECT o_custkey AS doc_id, o_orderkey * 10 + 2 AS pos, 'Priority' AS label, o_orderpriority AS value, 'high' AS confidence, 'paragraph' AS source, CAST(0.85 AS DOUBLE) AS score FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_custkey, 1099511627776 + o_orderkey, 'Total of sale', 'sum ' || o_orderkey, 'medium', 'table_cell', 0.88 FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '5-LOW')
""",
    "l12_form_scalars": f"""
WITH RECURSIVE {GROUPS}, taken AS (
  SELECT doc_id, t, g AS row FROM once UNION SELECT doc_id, t, unnest(places) FROM once
), found AS (
  SELECT doc_id, 1 AS rank, t * 1000000 + row AS pos, 'Key of sale' AS label, text AS value, 'table_cell' AS source, 0.88 AS score, row FROM rows WHERE kind = 'scalar'
  UNION ALL
  SELECT o_custkey, 0, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Key  of SALE' WHEN 'O' THEN 'PAID in part ' || o_orderkey ELSE 'Note' END, CASE o_orderstatus WHEN 'O' THEN 'yes' ELSE CAST(o_orderkey AS VARCHAR) END, 'line', 0.85, o_orderkey FROM orders
), firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, lower(replace(label, '  ', ' ')), value ORDER BY rank, pos) = 1)
SELECT doc_id, pos, label, value, source, CAST(score AS DOUBLE) AS score FROM firsts f
WHERE NOT (label = 'Note' AND EXISTS (SELECT 1 FROM taken x WHERE x.doc_id = f.doc_id AND x.t = 1 AND x.row = f.row))
  AND NOT (label LIKE 'PAID%' AND EXISTS (SELECT 1 FROM rows r WHERE r.doc_id = f.doc_id AND r.kind = 'option' AND r.row = f.row))
""",
    "p11_fragments": f"""
WITH RECURSIVE {GROUPS}, asked AS (SELECT DISTINCT doc_id, lower(question) AS q FROM every)
SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN 'Да' ELSE 'Note' END AS label,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 'is SALE ' || o_orderkey || ' delivered to  the client? see note' ELSE 'was Paid in part ' || o_orderkey || ' then' END AS value
FROM orders WHERE o_orderpriority <> '3-MEDIUM' AND NOT EXISTS (SELECT 1 FROM asked WHERE doc_id = o_custkey AND o_orderstatus = 'F' AND contains('да is sale ' || o_orderkey || ' delivered to the client? see note', q) AND o_orderpriority = '2-HIGH')
  AND NOT EXISTS (SELECT 1 FROM every e WHERE e.doc_id = o_custkey AND o_orderpriority <> '2-HIGH' AND list_contains(list_transform(e.options, lambda o: contains('was paid in part ' || o_orderkey || ' then', o.label)), true))
""",
    "f21_marks": r"""
WITH cells AS (SELECT *, ['l', ' O ', '☒', '1', '', '[x]', 'a[ ]b', '\'][p_size % 8 + 1] AS c FROM part),
words AS (SELECT *, regexp_extract_all(lower(p_type), '[a-zа-я0-9]+') AS a, regexp_extract_all(lower(p_name), '[a-zа-я0-9]+') AS b FROM cells),
stems AS (SELECT *, list_distinct(a) AS da, list_distinct(b) AS db, list_distinct(list_transform(a, lambda w: w[1:5])) AS sa, list_distinct(list_transform(b, lambda w: w[1:5])) AS sb FROM words)
SELECT p_partkey, CASE WHEN c IN ('l', '\') THEN 'X' WHEN c = ' O ' THEN '0' ELSE c END AS mark, c IN ('l', ' O ', '☒', '1', '\') AS is_mark, c IN ('l', '☒', '1', '\') AS checked, c <> '' AS has_mark,
  round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 WHEN a = b THEN 1 ELSE least(1, greatest(len(list_intersect(da, db)) / greatest(len(da), len(db)), len(list_intersect(sa, sb)) / greatest(len(sa), len(sb)))
    + CASE WHEN contains(array_to_string(a, ' '), array_to_string(b, ' ')) OR contains(array_to_string(b, ' '), array_to_string(a, ' ')) THEN 0.15 ELSE 0 END) END, 6) AS alike
FROM stems
""",
}
