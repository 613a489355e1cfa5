"""DuckDB SQL of texts, unique names, learning state and examples, written from the definitions."""

from __future__ import annotations

from fieldweave.operators.evaluation import TASKS
from fieldweave.plans.more_sql import SUGGESTIONS
from fieldweave.plans.sql_parts import HEADING, LABELS, LOG, NORMAL, SENTENCES, tokens

#: paragraphs of a document, numbered from 0, and whether they read like headings
PARAGRAPHS = rf"""
whole AS (
  SELECT doc_id, list_filter(list_transform(string_split({NORMAL}, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents
), each AS (
  SELECT doc_id, unnest(ps) AS line, unnest(range(len(ps))) AS pos FROM whole
), paragraphs AS (
  SELECT doc_id, pos, line, {HEADING} AS heading FROM each
)"""

FACT = [
    r"(?i)^([^.:]{2,60}?)\s+(?:is|are|equals|was|were)\s+([^.]{2,180})\.?$",
    r"(?i)^([^.:]{2,60}?)\s+(?:является|составляет|равен|равна|равно)\s+([^.]{2,180})\.?$",
]


def _fact(shape: str) -> str:
    label = rf"substr(regexp_replace(regexp_extract(s, '{shape}', 1), '^[ \-:;,]+|[ \-:;,]+$', '', 'g'), 1, 60)"
    return f"[{label}, trim(regexp_extract(s, '{shape}', 2))]"


LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _unique(gap: str, name: str) -> str:
    """The names of an order's lines in turn: each made new against all that stand before it."""
    made = f"CASE WHEN NOT list_contains(acc, x[1]) THEN x[1] ELSE x[1] || '{gap}' || list_filter(range(2, len(acc) + 3), lambda k: NOT list_contains(acc, x[1] || '{gap}' || k))[1] END"
    return f"""
WITH names AS (
  SELECT l_orderkey, list([{name}] ORDER BY {LINE}) AS given, list(l_linenumber ORDER BY {LINE}) AS ls FROM lineitem GROUP BY l_orderkey
), made AS (
  SELECT l_orderkey, ls, list_reduce(given, lambda acc, x: list_concat(acc, [{made}])) AS names FROM names
)
SELECT l_orderkey, unnest(ls) AS l_linenumber, unnest(names) AS """


def _rates(exact: str, wrong: str, unresolved: str) -> str:
    return ", ".join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {name}" for c, name in ((exact, "exact"), (wrong, "wrong"), (unresolved, "unresolved")))


SQL = {
    "x3_text_facts": rf"""
WITH sentences AS (
  SELECT doc_id, unnest({SENTENCES}) AS s, unnest(range(len({SENTENCES}))) AS pos FROM documents
), tried AS (
  SELECT doc_id, pos,
    CASE WHEN regexp_matches(s, '{FACT[0]}') THEN {_fact(FACT[0])} END AS a,
    CASE WHEN regexp_matches(s, '{FACT[1]}') THEN {_fact(FACT[1])} END AS b
  FROM sentences
), facts AS (
  SELECT doc_id, pos, CASE WHEN a[1] <> '' AND a[2] <> '' THEN a WHEN b[1] <> '' AND b[2] <> '' THEN b END AS f FROM tried
), firsts AS (
  SELECT doc_id, pos, f FROM facts WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, lower(f[1]), lower(f[2]) ORDER BY pos) = 1
)
SELECT doc_id, CAST(n AS INT) AS n, f[1] AS label, f[2] AS value
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM firsts) WHERE n <= 16
""",
    "x4_sections": rf"""
WITH {PARAGRAPHS}, placed AS (
  SELECT *, coalesce(last_value(CASE WHEN heading THEN line END IGNORE NULLS) OVER w, 'Document') AS title, count(*) FILTER (heading) OVER w AS part
  FROM paragraphs WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), bodies AS (
  SELECT doc_id, part, any_value(title) AS title, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text FROM placed WHERE NOT heading GROUP BY doc_id, part
), numbered AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS section, title, text FROM bodies
)
SELECT doc_id, CAST(section AS INT) AS section, title, text FROM numbered WHERE section <= 12
UNION ALL
SELECT doc_id, 1, 'Document', string_agg(line, chr(10) || chr(10) ORDER BY pos) FILTER (pos < 3) FROM paragraphs GROUP BY doc_id HAVING bool_and(heading)
""",
    "t8_text_blocks": rf"""
WITH {PARAGRAPHS}
SELECT doc_id, CAST(pos + 1 AS INT) AS n, line AS block, CASE WHEN heading THEN line END AS label FROM paragraphs WHERE pos < 24
""",
    "x2_inline_pairs": """
SELECT c_custkey AS doc_id, unnest([1, 2, 3, 4]) AS n, unnest(['ФИО', 'телефон', 'адрес', 'email']) AS label,
  unnest([c_name, '+7 ' || c_custkey, 'Town ' || c_nationkey, 'x@y.zz']) AS value
FROM customer WHERE c_nationkey <= 20
""",
    "x7_wide_pairs": """
WITH pairs AS (
  SELECT o_custkey AS doc_id, o_orderkey AS row, unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN [['rush', 'yes'], ['key', CAST(o_orderkey AS VARCHAR)]]
    ELSE [['key', CAST(o_orderkey AS VARCHAR)], ['order status', o_orderstatus], ['priority', o_orderpriority]] END) AS p,
    unnest(range(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END)) AS pos FROM orders
), columns AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place FROM (SELECT doc_id, p[1] AS label, min((row, pos)) AS first FROM pairs GROUP BY 1, 2)
), rows AS (
  SELECT DISTINCT doc_id, row FROM pairs WHERE doc_id IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)
)
SELECT doc_id, row, CAST(place AS INT) AS place, label, coalesce(p[2], '') AS value
FROM rows JOIN columns USING (doc_id) LEFT JOIN pairs USING (doc_id, row) WHERE p[1] = label
UNION ALL
SELECT doc_id, row, CAST(place AS INT), label, '' FROM rows r JOIN columns c USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.doc_id = r.doc_id AND q.row = r.row AND q.p[1] = c.label)
""",
    "w11_unique_keys": _unique("", "lower(l_returnflag) || CASE WHEN l_linenumber % 3 = 0 THEN '2' ELSE '' END") + "key FROM made",
    "w12_unique_labels": _unique(" ", "l_linestatus || CASE WHEN l_quantity > 25 THEN ' 2' ELSE '' END") + "label FROM made",
    "l7_unique_names": f"""
WITH cells AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_linestatus) WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END AS mode, l_quantity > 25 AS more, ({LINE}) AS place FROM lineitem
), named AS (
  SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(mode || CASE WHEN more THEN ' a' ELSE '' END), ''), 'column_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY place)) AS name, place FROM cells
), counted AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(name) ORDER BY place) AS k FROM named)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS unique_name FROM counted
""",
    "m5_by_position": """
WITH s AS (
  SELECT l_orderkey AS case_id, 'c' || l_partkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, 'c' || l_partkey NULLS FIRST) AS k FROM lineitem
), f AS (
  SELECT l_orderkey AS case_id, l_linenumber AS pos, 't' || l_linenumber AS target, CASE WHEN l_returnflag = 'R' THEN 'c' || l_partkey END AS own FROM lineitem
  UNION ALL SELECT o_orderkey, 100, 'more', NULL FROM orders WHERE o_orderpriority = '1-URGENT'
), t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos NULLS FIRST, target NULLS FIRST) AS k FROM f),
open AS (
  SELECT case_id FROM (SELECT case_id, count(*) AS m FROM f GROUP BY 1 HAVING count(own) = 0) JOIN (SELECT case_id, count(*) AS n FROM s GROUP BY 1) USING (case_id) WHERE n = m
)
SELECT t.case_id, target, coalesce(s.source, 'none') AS source, 'low' AS band, 'position_fallback' AS reason FROM t JOIN open USING (case_id) JOIN s USING (case_id, k)
UNION ALL
SELECT case_id, target, coalesce(own, 'none'), CASE WHEN own IS NULL THEN 'none' ELSE 'high' END, CASE WHEN own IS NULL THEN 'not_found' ELSE 'returned' END
FROM t WHERE NOT EXISTS (SELECT 1 FROM open WHERE open.case_id = t.case_id)
""",
    "a8_review_states": f"""
WITH {SUGGESTIONS}, n AS (
  SELECT run_id, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (status = 'suggested' AND source IS NOT NULL) AS pending FROM sug GROUP BY run_id
)
SELECT *, CASE WHEN rejected > 0 THEN 'has_rejected_suggestions' WHEN pending > 0 THEN 'has_pending_suggestions' ELSE 'confirmed' END AS state FROM n
""",
    "m33_snapshot": """
WITH chosen AS (SELECT event_id, value, md5(CAST(event_id AS VARCHAR)) AS h FROM events WHERE value / 100 >= 0.75)
SELECT CASE WHEN value / 100 >= 0.85 THEN 'train' ELSE 'validation' END AS split, count(*) AS items, min(event_id) AS first_id, max(event_id) AS last_id,
  concat_ws('-', CAST(sum(CAST('0x' || h[1:8] AS BIGINT)) AS BIGINT), CAST(sum(CAST('0x' || h[9:16] AS BIGINT)) AS BIGINT), CAST(sum(CAST('0x' || h[17:24] AS BIGINT)) AS BIGINT), CAST(sum(CAST('0x' || h[25:32] AS BIGINT)) AS BIGINT)) AS identity
FROM chosen GROUP BY 1
""",
    "m34_training_examples": f"""
WITH {LOG}, items AS (
  SELECT event_id AS id, CASE WHEN source = 'email' THEN 'template' ELSE 'correction' END AS item_kind, confidence,
    CASE WHEN source = 'email' THEN '{{"raw_input":[1]}}' ELSE '{{"source":"' || source || '","user_id":' || user_id || '}}' END AS asked,
    source = 'revenue amount' AS drafted,
    CASE WHEN accepted THEN '"' || target || '"' ELSE 'null' END AS answer
  FROM log WHERE confidence >= 0.72
), typed AS (SELECT *, CASE WHEN drafted OR item_kind = 'template' THEN 'draft_json' ELSE 'mapping' END AS task_type FROM items)
SELECT id, task_type, item_kind, CASE WHEN confidence >= 0.85 THEN 'train' ELSE 'validation' END AS split, round(confidence, 4) AS quality_score,
  ['system ' || CASE task_type WHEN 'draft_json' THEN '{TASKS["draft_json"]}' ELSE '{TASKS["mapping"]}' END, 'user ' || asked,
   'assistant ' || CASE WHEN drafted THEN '{{"value":0}}' ELSE '{{"confidence":' || CAST(confidence AS VARCHAR) || ',"target":' || answer || '}}' END] AS messages
FROM typed
""",
    "m35_feature_vectors": f"""
WITH {LOG}, {LABELS}, names AS (SELECT label, array_to_string({tokens('label')}, '') AS name FROM labels),
runs AS (
  SELECT user_id AS id, list(s.name ORDER BY event_id) AS sources, list(t.name ORDER BY event_id) AS targets, count(*) AS rows, count(*) FILTER (confidence >= 0.9) AS high,
    count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.7) AS low, count(*) FILTER (NOT accepted) AS warnings, ['csv', 'xls', 'pdf', 'txt'][user_id % 4 + 1] AS file_type
  FROM log JOIN names s ON s.label = source JOIN names t ON t.label = target GROUP BY user_id
), vectors AS (
  SELECT *, [round(least(len(sources), 64) / 64, 6), round(least(len(targets), 64) / 64, 6), round(least(rows, 10) / 10, 6), 0.1,
    round(len(list_intersect(list_distinct(sources), list_distinct(targets))) / greatest(1, len(list_distinct(list_concat(sources, targets)))), 6),
    round(high / rows, 6), round(medium / rows, 6), round(low / rows, 6), 0.0, round(least(warnings, 10) / 10, 6),
    CASE WHEN file_type = 'csv' THEN 1.0 ELSE 0.0 END, CASE WHEN file_type = 'xls' THEN 1.0 ELSE 0.0 END, CASE WHEN file_type = 'pdf' THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS vector FROM runs
), words AS (
  SELECT id, unnest(list_concat(list_transform(sources[1:48], lambda x: 'source:' || x), list_transform(targets[1:48], lambda x: 'target:' || x), ['file_type:' || file_type])) AS w FROM runs
), bags AS (SELECT id, string_agg(w || '=' || n, ' ' ORDER BY w || '=' || n) AS tokens FROM (SELECT id, w, count(*) AS n FROM words GROUP BY ALL) GROUP BY id)
SELECT id, vector, tokens, round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) AS l2_norm FROM vectors JOIN bags USING (id)
""",
    "j20_case_deltas": f"""
WITH off_run AS (
  SELECT l_suppkey AS case_id, {_rates("l_returnflag = 'A'", "l_returnflag = 'R'", "l_returnflag = 'N'")} FROM lineitem GROUP BY 1
  UNION ALL SELECT -l_orderkey - 1, {_rates("l_returnflag = 'A'", "l_returnflag = 'R'", "l_returnflag = 'N'")} FROM lineitem WHERE l_linestatus IS DISTINCT FROM 'O' GROUP BY 1
), on_run AS (
  SELECT l_suppkey AS case_id, {_rates("l_linenumber = 1", "l_linenumber = 2", "l_linestatus = 'O'")} FROM lineitem GROUP BY 1
  UNION ALL SELECT -l_orderkey - 1, {_rates("l_returnflag = 'A'", "l_returnflag = 'R'", "l_returnflag = 'N'")} FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1
), cases AS (
  SELECT s_suppkey AS case_id FROM supplier UNION SELECT -o_orderkey - 1 FROM orders UNION SELECT case_id FROM off_run UNION SELECT case_id FROM on_run
)
SELECT c.case_id, round(coalesce(b.exact, 0) - coalesce(a.exact, 0), 4) AS exact_delta, round(coalesce(b.wrong, 0) - coalesce(a.wrong, 0), 4) AS false_positive_delta,
  round(coalesce(b.unresolved, 0) - coalesce(a.unresolved, 0), 4) AS unresolved_delta
FROM cases c LEFT JOIN off_run a ON a.case_id IS NOT DISTINCT FROM c.case_id LEFT JOIN on_run b ON b.case_id IS NOT DISTINCT FROM c.case_id
""",
    "j13_run_context": """
WITH runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS owner FROM orders UNION ALL SELECT -c_custkey - 1, c_nationkey FROM customer
), made AS (
  SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS version, l_returnflag AS state, l_extendedprice AS price FROM lineitem
  UNION ALL SELECT -o_custkey - 1, o_orderkey, o_orderstatus, o_totalprice FROM orders
), newest AS (
  SELECT run_id, version, min(state) AS state FROM made WHERE version IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY version DESC) = 1
), artifacts AS (SELECT run_id, version, max(price) AS price FROM made GROUP BY 1, 2)
SELECT run_id, owner, coalesce(version, -1) AS version, coalesce(state, 'none') AS state, coalesce(price, -1) AS price
FROM runs LEFT JOIN newest USING (run_id) LEFT JOIN artifacts USING (run_id, version)
""",
    "m44_structure_changes": """
WITH old AS (SELECT s_suppkey AS key, s_nationkey AS nation FROM supplier UNION ALL SELECT -o_custkey, count(*) FROM orders GROUP BY 1)
SELECT CASE WHEN o.key IS NULL THEN 'initial' WHEN c_custkey IS NULL THEN 'removed' WHEN nation = c_nationkey THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n
FROM old o FULL JOIN customer ON o.key = c_custkey GROUP BY 1
""",
}
