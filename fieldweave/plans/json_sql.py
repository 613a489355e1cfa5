"""DuckDB SQL of JSON of unknown shape, from how the texts are made."""

from __future__ import annotations

SQL = {
    "sc12_json_rows": """
WITH e AS (SELECT CAST(event_id AS BIGINT) AS doc_id, event_type, props, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events)
SELECT doc_id, unnest([0, 0, 0, 1]) AS row, unnest(['id', 'ok', 'props', 'v']) AS key, unnest(['1', 'true', CAST(CAST(props AS JSON) AS VARCHAR), v]) AS text, unnest(['BIGINT', 'BOOLEAN', 'OBJECT', 'STRING']) AS kind FROM (SELECT doc_id, event_type, v, replace(props, ' ', '') AS props FROM e) WHERE event_type = 'click'
UNION ALL
SELECT doc_id, unnest([0, 0, 1]), unnest(['none', 'v', 'list']), unnest([NULL, v, '[1,2]']), unnest(['VOID', 'BIGINT', 'ARRAY']) FROM e WHERE event_type = 'view'
""",
    "f32_targets": """
SELECT CAST(event_id AS BIGINT) AS doc_id, CASE event_type WHEN 'click' THEN 'array' WHEN 'purchase' THEN 'array' WHEN 'view' THEN 'object' ELSE 'other' END AS root,
  CASE event_type WHEN 'click' THEN 'id,ok,props,v' WHEN 'purchase' THEN 'm,n' WHEN 'view' THEN 'more,rows' ELSE '' END AS fields FROM events
""",
    "f29_payloads": """
WITH e AS (SELECT CAST(event_id AS BIGINT) AS doc_id, event_type, replace(props, ' ', '') AS p, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events)
SELECT doc_id, CASE event_type WHEN 'click' THEN '[{"id":1,"ok":true,"props":' || p || '},5,{"v":"' || v || '"}]' WHEN 'view' THEN '{"more":1,"rows":[{"none":null,"v":' || v || '},null,{"list":[1,2]}]}'
  WHEN 'signup' THEN '{"mappings":[{"v":' || v || '}]}' WHEN 'purchase' THEN '{"DATA ":[{"n":' || v || '},{"m":' || p || '}]}' ELSE '[' || v || ']' END AS payload FROM e
""",
    "sc10_parsed_files": """
SELECT o_custkey AS doc_id, 'f' || o_custkey AS file_name, CASE WHEN o_custkey % 2 = 0 THEN 'csv' ELSE 'unknown' END AS file_type, 'unknown' AS content_type, 'data_table_mode' AS document_mode, 'unknown' AS extraction_status, '' AS raw_text, 'x,1' AS columns,
  1 AS n_rows, 0 AS n_text_blocks, 0 AS n_sections, CAST(count(*) AS INT) AS n_kv_pairs, 0 AS n_source_candidates, CAST(count(*) AS INT) AS n_sheets FROM orders GROUP BY o_custkey
""",
    "sc10_file_pairs": """
SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n, 'order' AS label, CASE WHEN o_orderkey = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS value, CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'medium' END AS confidence FROM orders
""",
    "sc10_file_sheets": """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT o_custkey AS doc_id, CAST(n AS INT) AS sheet, CASE WHEN o_orderstatus = 'F' THEN 's' || o_orderkey ELSE 'Sheet ' || n END AS name, 'a,2' AS columns, '{"a":' || o_custkey || '}' AS rows FROM s
""",
}
