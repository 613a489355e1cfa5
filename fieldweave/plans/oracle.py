"""The same queries in DuckDB's SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

from fieldweave.functions import lexicon as L
from fieldweave.plans import form_sql, graph_sql, json_sql, more_sql, page_sql, quality_sql, read_sql, state_sql, text_sql
from fieldweave.plans.sql_parts import CASES, EDGES, ESTIMATE, GATES, HEADING, LINES, LOG, NAMED, ORDERS, SENTENCES, STATS, _list, meanings, tokens

ORACLE_SQL: dict[str, str] = {
    "p1_transform_orders": f"WITH {ORDERS} SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS key, TRY_CAST(replace(price, ',', '.') AS DOUBLE) AS total, o_orderstatus AS status, urgent = 'yes' AS urgent, CAST(CASE WHEN price = 'n/a' THEN 1 ELSE 0 END AS INT) AS faults FROM cells",
    "m37_validate_orders": f"WITH {ORDERS} SELECT 'order.total' AS path, 'type_mismatch' AS code, count(*) AS n FROM cells WHERE price = 'n/a' UNION ALL SELECT 'note', 'missing_required_field', count(*) FROM cells",
    "p5_filled_rows": "SELECT event_id FROM events WHERE (CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) / 3 >= 0.35",
    "p19_wide_fields": "SELECT user_id, " + ", ".join(f"arg_max(json_extract_string(props, '$.k'), event_id) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "f13_column_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (v IS NULL OR trim(v) = '') / count(*) AS null_ratio, count(DISTINCT v) FILTER (trim(v) <> '') AS distinct_values, "
        f"CASE WHEN bool_and(lower(trim(v)) IN ({_list(L.INFERRED_TRUE + L.INFERRED_FALSE)})) THEN 'boolean' WHEN bool_and(regexp_full_match(trim(v), '[-+]?\\d+([.,]\\d+)?')) THEN 'number' ELSE 'string' END AS type FROM (SELECT CAST({c} AS VARCHAR) AS v FROM customer)"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ),
    "f1_name_tokens": f"SELECT p_partkey, array_to_string(t, ' ') AS tokens, array_to_string(t, '') AS normalized, array_to_string({meanings('t')}, ' ') AS canonical FROM (SELECT p_partkey, {tokens('p_type')} AS t FROM part)",
    "f5_semantic_parts": f"WITH {LOG}, labels AS (SELECT label FROM (SELECT source AS label FROM log UNION ALL SELECT target FROM log) GROUP BY label), counts AS (SELECT label, count(*) AS n FROM (SELECT source AS label FROM log UNION ALL SELECT target FROM log) GROUP BY label), {NAMED} SELECT label, n, attribute, entity, role, array_to_string(list_filter([CASE WHEN list_has_any(canonical, ['date', 'created', 'updated']) THEN 'date' END, CASE WHEN list_has_any(canonical, ['amount', 'revenue', 'quantity']) THEN 'number' END, CASE WHEN list_contains(canonical, 'id') THEN 'id' END, CASE WHEN list_contains(canonical, 'boolean') THEN 'boolean' END, CASE WHEN list_has_any(canonical, ['name', 'description']) THEN 'string' END], lambda x: x IS NOT NULL), ',') AS hints FROM named JOIN counts USING (label)",
    "f7_value_types": f"SELECT CASE WHEN v IS NULL OR trim(v) = '' THEN 'null' WHEN lower(trim(v)) IN ({_list(L.SAMPLE_BOOLEANS)}) THEN 'boolean' WHEN regexp_full_match(v, '[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?') THEN 'number' WHEN length(v) >= 8 AND regexp_matches(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN 'date' ELSE 'string' END AS type, count(*) AS n FROM (SELECT unnest([CAST(value AS VARCHAR), event_type, strftime(ts, '%d.%m.%Y'), CASE WHEN event_id % 2 = 0 THEN 'Yes' END, json_extract_string(props, '$.k')]) AS v FROM events) GROUP BY 1",
    "f28_token_estimate": f"SELECT role, CAST(sum({ESTIMATE}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY role",
    "f16_sentences": f"SELECT doc_id, CAST(len({SENTENCES}) AS INT) AS sentences FROM documents",
    "f17_headings": f"WITH {LINES} SELECT doc_id, count(*) AS headings FROM lines WHERE {HEADING} GROUP BY doc_id",
    "sc16_html_items": r"SELECT page_id, CAST(n AS INT) AS n, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + "\"" + r"'), '&#39;', ''''), '\s+', ' ', 'g')) AS item FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?si)<li[^>]*>(.*?)</li>', 1)) AS raw, unnest(range(1, len(regexp_extract_all(html, '(?si)<li[^>]*>(.*?)</li>', 1)) + 1)) AS n FROM pages)",
    "a1_memory": f"WITH {LOG} SELECT user_id, source, target, count(*) AS usage_count, count(*) FILTER (accepted) AS success_count, count(*) FILTER (NOT accepted) AS failure_count, arg_max(accepted, (ts, event_id)) AS last_accepted, avg(confidence) AS mean_confidence, coalesce(sum(greatest(confidence, 0.2)) FILTER (accepted), 0.0) AS weight FROM log GROUP BY user_id, source, target",
    "m15_personal_candidates": f"WITH {LOG}, m AS (SELECT user_id, source, target, least(1.0, 0.55 * avg(confidence) + 0.25 * count(*) FILTER (accepted) / count(*) + 0.1 * least(count(*) / 4, 1.0)) AS score FROM log GROUP BY user_id, source, target) SELECT user_id, source, target, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, source, target) AS rank FROM m) WHERE rank <= 3",
    "m20_pattern_stats": f"WITH {STATS} SELECT * FROM stats",
    "m21_promotion": f"WITH {STATS} SELECT source, target, g[1] AS status, g[2] AS reason FROM (SELECT *, {GATES} AS g FROM stats)",
    "m22_bulk_promotion": f"WITH {STATS} SELECT source, target, CASE WHEN generality < 0.5 THEN 'personal_only' WHEN sensitivity >= 0.6 THEN 'blocked_sensitive' WHEN conflict > 0.15 THEN 'personal_only' WHEN acceptance < 0.8 THEN 'shared_candidate' WHEN support >= 3 AND users >= 2 AND acceptance >= 0.5 AND drift <= 0.25 THEN 'shared_promoted' ELSE g[1] END AS status, CASE WHEN generality < 0.5 THEN 'not_generalizable' WHEN sensitivity >= 0.6 THEN 'sensitive_context' WHEN conflict > 0.15 THEN 'semantic_instability' WHEN acceptance < 0.8 THEN 'low_acceptance_rate' WHEN support >= 3 AND users >= 2 AND acceptance >= 0.5 AND drift <= 0.25 THEN 'manual_threshold_promotion' ELSE g[2] END AS reason FROM (SELECT *, {GATES} AS g FROM stats)",
    "m16_shared_candidates": f"WITH {STATS} SELECT source, target, least(1.0, 0.35 * mean_confidence + 0.35 * acceptance + 0.2 * least(support / 5, 1.0) + 0.1 * least(users / 3, 1.0)) AS score FROM stats WHERE sensitivity < 0.6",
    "w16_status_changes": f"WITH {LOG}, d AS (SELECT source, target, date_trunc('day', ts) AS period, count(*) FILTER (accepted) AS a, count(*) AS n FROM log GROUP BY ALL), r AS (SELECT source, target, CAST(period AS TIMESTAMP) AS period, sum(a) OVER w / sum(n) OVER w AS acceptance FROM d WINDOW w AS (PARTITION BY source, target ORDER BY period)), s AS (SELECT *, CASE WHEN acceptance >= 0.8 THEN 'stable' ELSE 'unstable' END AS standing FROM r) SELECT source, target, period, before, standing, acceptance FROM (SELECT *, lag(standing) OVER (PARTITION BY source, target ORDER BY period) AS before FROM s) WHERE before IS NULL OR before <> standing",
    "u2_event_feed": """WITH f AS (SELECT 'event' AS kind, ts AS "at", event_id AS id, event_type AS title FROM events UNION ALL SELECT 'order', o_orderdate, o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'shipment', l_shipdate, l_orderkey * 10 + l_linenumber, l_returnflag FROM lineitem) SELECT * FROM f ORDER BY "at" DESC NULLS LAST, kind, id DESC LIMIT 50""",
    "m25_graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "j6_incident_edges": f"WITH {EDGES} SELECT node, other, accepts, rejects FROM both_ways WHERE node IN (SELECT r FROM edges WHERE relation = 'synonym')",
    "j1_run_history": "SELECT o_orderkey, o_orderdate, c_name, last_ship, coalesce(quantity, 0.0) AS quantity, coalesce(n_lines, 0) AS n_lines FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "a9_token_totals": f"SELECT conv_id, CAST(coalesce(sum({ESTIMATE}) FILTER (role = 'user'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum({ESTIMATE}) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens, count(*) AS turns, CAST(coalesce(sum({ESTIMATE}) FILTER (role IN ('user', 'assistant')), 0) AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id",
    "a10_usage_report": f"WITH t AS (SELECT conv_id, coalesce(sum({ESTIMATE}) FILTER (role = 'user'), 0) AS i, coalesce(sum({ESTIMATE}) FILTER (role = 'assistant'), 0) AS o, CASE WHEN count(*) <= 2 THEN 'short' ELSE 'long' END AS size FROM conversations GROUP BY conv_id) SELECT size, count(*) AS runs, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM t GROUP BY ROLLUP (size)",
    "w15_versions": "WITH c AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version FROM c WHERE before IS NULL OR before <> event_type",
    "m43_expired": "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR GROUP BY event_type",
    "w14_newest_orders": "SELECT o_custkey, o_orderkey, o_orderdate, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3",
    "w13_spread_sample": "WITH r AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, line, CAST(i AS INT) AS i FROM r WHERE n <= 5 OR i IN (SELECT CAST(round_even(k * (n - 1) / 4.0, 0) AS INT) FROM range(5) t(k))",
    "a11_accuracy": f"WITH {CASES} SELECT lang, count(*) AS cases, avg(CASE WHEN expected = got THEN 1 ELSE 0 END) AS accuracy FROM cases GROUP BY ROLLUP (lang)",
    "a12_outcomes": f"WITH {CASES}, c AS (SELECT lang, expected, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE got END AS got FROM cases) SELECT lang, count(*) FILTER (got = expected) AS exact, count(*) FILTER (got <> expected) AS false_positive, count(*) FILTER (got IS NULL) AS unresolved, count(*) FILTER (got IS NOT DISTINCT FROM expected) AS correct_outcome, count(*) FILTER (got = expected) / nullif(count(got), 0) AS precision FROM c GROUP BY lang",
    "a13_deltas": f"WITH {CASES} SELECT CASE WHEN expected = got AND expected <> 1 THEN 'improved' WHEN expected <> got AND expected = 1 THEN 'regressed' ELSE 'unchanged' END AS outcome, count(*) AS n FROM cases GROUP BY 1",
    "a15_run_status": "WITH r AS (SELECT l_orderkey, count(*) AS fields, count(*) FILTER (l_returnflag = 'R') AS unresolved, count(*) FILTER (l_linestatus = 'O') AS suggested FROM lineitem GROUP BY 1) SELECT *, round((fields - unresolved) / fields, 4) AS resolved_ratio, round((suggested + unresolved) / fields, 4) AS review_ratio, CASE WHEN (fields - unresolved) / fields >= 0.9 AND unresolved = 0 AND (suggested + unresolved) / fields <= 0.35 THEN 'high' WHEN (fields - unresolved) / fields >= 0.7 AND unresolved <= greatest(1, fields // 4) THEN 'medium' ELSE 'low' END AS status FROM r",
    "s1_acceptance_windows": f"WITH {LOG} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS from_ts, source, count(*) FILTER (accepted) AS accepts, count(*) AS n FROM log GROUP BY 1, 2",
    "w4_blocks": "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10))))) AS pos FROM documents), b AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM l) SELECT doc_id, block, count(*) AS lines FROM b WHERE trim(line) <> '' GROUP BY 1, 2",
    "w10_first_of_equal": "SELECT p_partkey, p_brand, p_type FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_partkey) = 1",
    "a25_dominant_width": "WITH r AS (SELECT doc_id, len(string_split(unnest(string_split(text, chr(10))), ' ')) AS width FROM documents), n AS (SELECT doc_id, width, count(*) AS n FROM r GROUP BY 1, 2) SELECT doc_id, CAST(width AS INT) AS width, n AS rows FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, width DESC) = 1",
    "m36_fingerprints": "SELECT p_partkey, sha256('[\"' || p_brand || '\",\"' || lower(p_type) || '\",\"' || p_size || '\"]') AS fingerprint FROM part",
    "j9_item_owners": "WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'customer' WHEN 'A' THEN 'part' ELSE 'supplier' END AS kind, CASE l_returnflag WHEN 'R' THEN l_orderkey % 1500 WHEN 'A' THEN l_partkey ELSE l_suppkey END AS ref FROM lineitem) SELECT i.*, coalesce(c_name, p_name, s_name, 'none') AS owner FROM i LEFT JOIN customer ON kind = 'customer' AND ref = c_custkey LEFT JOIN part ON kind = 'part' AND ref = p_partkey LEFT JOIN supplier ON kind = 'supplier' AND ref = s_suppkey",
    "j10_relevant_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority LIKE '1%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "t2_pattern_list": f"WITH {STATS}, p AS (SELECT *, {GATES} AS g FROM stats) SELECT source, target, g[1] AS status, support FROM p ORDER BY CASE g[1] WHEN 'shared_promoted' THEN 3 WHEN 'shared_candidate' THEN 2 WHEN 'personal_only' THEN 1 ELSE 0 END DESC, acceptance DESC, support DESC, source, target LIMIT 12",
    "j3_memory_layers": f"WITH {LOG} SELECT source, count(DISTINCT (user_id, target)) AS remembered, count(*) AS uses, count(*) FILTER (NOT accepted) AS rejected, count(DISTINCT user_id) AS users FROM log GROUP BY source",
    "u3_united_sheets": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, 0.0::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, '', s_acctbal FROM supplier",
    "a14_run_quality": "SELECT l_orderkey, greatest(0.0, least(1.0, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.7 WHEN l_linenumber % 2 = 0 THEN 0.4 ELSE 0.0 END) - least(0.08 * max(l_linenumber - 1), 0.35))) AS quality FROM lineitem GROUP BY 1",
}


ORACLE_SQL |= more_sql.SQL | text_sql.SQL | form_sql.SQL | graph_sql.SQL | json_sql.SQL | page_sql.SQL | quality_sql.SQL | read_sql.SQL | state_sql.SQL
