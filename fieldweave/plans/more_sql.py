"""DuckDB SQL of ``more_queries`` and of the queries whose definitions need it most, written from the definitions. Imported by ``oracle`` last."""

from __future__ import annotations

from fieldweave.functions import lexicon as L
from fieldweave.functions import values as V
from fieldweave.plans.sql_parts import EDGES, GATES, HEADING, LABELS, LOG, NAMED, NORMAL, STATS, _list, _map, meanings, tokens

#: the log with a status, as in sample_log.suggestions
SUGGESTIONS = f"""{LOG}, sug AS (
  SELECT user_id * 1000 + dayofyear(ts) AS run_id, user_id, ts, CASE WHEN event_id % 11 <> 0 THEN source END AS source, target, CASE WHEN event_id % 4 = 0 THEN 'model_suggestion' ELSE 'deterministic' END AS truth,
    CASE WHEN event_id % 3 = 0 THEN 'suggested' WHEN accepted THEN 'accepted' ELSE 'rejected' END AS status, confidence FROM log
)"""
MEMORY = "memory AS (SELECT user_id, source, target, count(*) AS usage_count, count(*) FILTER (accepted) AS success_count, count(*) FILTER (NOT accepted) AS failure_count, coalesce(sum(greatest(confidence, 0.2)) FILTER (accepted), 0.0) AS weight, max(ts) AS last_used FROM log GROUP BY 1, 2, 3)"
PATTERNS = f"{STATS}, patterns AS (SELECT *, g[1] AS status, g[2] AS reason FROM (SELECT *, {GATES} AS g FROM stats))"
USER_EDGES = f"named_labels AS (SELECT label, array_to_string({tokens('label')}, '') AS name FROM labels), user_edges AS (SELECT g.user_id, least(s.name, t.name) AS l, greatest(s.name, t.name) AS r, count(*) FILTER (accepted) AS accepts, count(*) FILTER (NOT accepted) AS rejects FROM log g JOIN named_labels s ON s.label = g.source JOIN named_labels t ON t.label = g.target WHERE s.name <> t.name GROUP BY g.user_id, g.source, g.target, s.name, t.name)"
CLUSTERS = f"{EDGES}, live AS (SELECT * FROM edges WHERE relation = 'synonym' AND accepts > 0), hops AS (SELECT l AS node, r AS other FROM live UNION SELECT r, l FROM live), reach(node, other) AS (SELECT node, node FROM hops UNION SELECT r.node, b.other FROM reach r JOIN hops b ON b.node = r.other), member AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node)"

_words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
_strip = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
_contains = lambda x, parts: "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"
HEADS = _contains("lower(text)", ["сведения", "анкета", "форма", "приложение", "согласие", "подпись", "дата", "page"])
ASKS = _contains("lower(text)", ["является ли", "являются ли", "is ", "are ", "?"])
CHECKS = _contains("text", ["[X]", "[x]", "☒", "☑", "✓", "✔"])
ZONED = rf"""
short AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
counted AS (SELECT doc_id, pos, text, {_words('text')} AS words, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Lu}}')) AS caps FROM short WHERE trim(text) <> ''),
zoned AS (SELECT doc_id, text, words, pos * 14.0 + (pos // 5) * 20 AS y,
  CASE WHEN words = 0 OR (words >= 3 AND letters > 0 AND caps / greatest(letters, 1) >= 0.9) OR ({HEADS} AND words >= 3) OR words >= 18 THEN 'noise'
       WHEN (contains(text, ':') AND words BETWEEN 1 AND 12) OR {CHECKS} OR (regexp_matches(text, '^[XxVv]') AND words <= 16) OR {ASKS} THEN 'form' ELSE 'text' END AS zone FROM counted),
stepped AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) > 26 THEN 1 ELSE 0 END AS new FROM zoned),
placed AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY y) AS BIGINT) AS region FROM stepped),
summed AS (SELECT doc_id, region, count(*) AS lines, count(*) FILTER (zone = 'noise') AS noise, count(*) FILTER (zone = 'form') AS form, avg(words) AS mean, bool_or({HEADS}) AS headed FROM placed GROUP BY 1, 2),
regions AS (SELECT doc_id, region, lines, CASE WHEN noise >= greatest(1, lines - 1) THEN {{'z': 'noise', 's': 0.86}} WHEN form >= greatest(1, lines // 2) THEN {{'z': 'form', 's': 0.8}} WHEN mean >= 9 OR lines >= 3 THEN {{'z': 'text', 's': 0.74}} WHEN headed THEN {{'z': 'noise', 's': 0.78}} ELSE {{'z': 'text', 's': 0.58}} END AS v FROM summed)"""
_misread = lambda x: f"translate({x}, '01', 'Ol')"
OCR = f"""ocr AS (SELECT o_custkey % 50 AS "table", unnest([0, 1, 2, 3]) AS col, unnest([{_misread('CAST(o_orderkey AS VARCHAR)')}, {_misread("strftime(o_orderdate, '%d.%m.%Y')")}, 'Хoлoд ' || o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '1O,5' ELSE 'none' END]) AS value FROM orders)"""
_number = f"translate(replace(translate(trim(value), '{V.NUMBER_SIGNS}', '{V.NUMBER_DIGITS}'), ' ', ''), '−—', '--')"
_is_number = f"regexp_full_match({_number}, '[-+]?\\d+([.,]\\d+)?')"
_date = f"regexp_replace(regexp_replace(translate(trim(value), '{V.DATE_SIGNS}', '{V.DATE_DIGITS}'), '[./\\\\]', '-', 'g'), '\\s+', '', 'g')"
_day = f"coalesce(try_strptime({_date}, '%d-%m-%Y'), try_strptime({_date}, '%Y-%m-%d'))"
OCR_TYPES = f"""{OCR}, kinds AS (SELECT *, CASE WHEN regexp_full_match({_date}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}|\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND {_day} IS NOT NULL THEN 'date' WHEN {_is_number} THEN 'number' WHEN trim(value) <> '' THEN 'text' END AS kind FROM ocr),
tallied AS (SELECT "table", col, count(*) FILTER (kind = 'date') AS d, count(*) FILTER (kind = 'number') AS m, count(*) FILTER (kind = 'text') AS t FROM kinds GROUP BY 1, 2),
types AS (SELECT "table", col, CASE WHEN d > 0 AND d >= greatest(m, t) THEN 'date' WHEN m > 0 AND m >= greatest(d, t) THEN 'number' ELSE 'text' END AS type FROM tallied)"""
FLAT = """row_cells AS (SELECT c_custkey AS doc_id, unnest(range(18)) AS pos, unnest(flatten(list_transform([0, 1, 2], lambda k: ['deal_' || c_custkey, 'item ' || c_name, '2024-01-1' || k, lower(c_mktsegment), CASE WHEN c_nationkey % 2 = 0 THEN 'ООО Ромашка' ELSE 'Иван Петров' END, printf('%.2f', c_acctbal)]))) AS value FROM customer),
sized AS (SELECT *, unnest([2, 3, 6, 9]) AS width FROM row_cells),
classed AS (SELECT doc_id, pos, width, pos % width AS col, CASE WHEN regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}') THEN 'date' WHEN regexp_full_match(value, '[+-]?\\d+([.,]\\d+)?') THEN 'number' WHEN starts_with(value, 'deal_') THEN 'identifier' WHEN starts_with(value, 'ООО') THEN 'organization' WHEN regexp_matches(value, '^\\p{Lu}[^ ]* \\p{Lu}') THEN 'person' ELSE 'text' END AS kind FROM sized),
grouped AS (SELECT doc_id, width, col, kind, count(*) AS n, min(pos) AS first FROM classed GROUP BY ALL),
cols AS (SELECT doc_id, width, col, arg_max(kind, (n, -first)) AS kind, max(n) AS top, sum(n) AS whole, count(*) AS kinds, bool_or(kind = 'text') AS has_text FROM grouped GROUP BY 1, 2, 3),
widths AS (SELECT doc_id, width, round(sum(top / whole + CASE WHEN kinds = 1 AND NOT has_text THEN 0.5 ELSE 0 END), 6) AS score FROM cols GROUP BY 1, 2),
best AS (SELECT * FROM widths QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, width) = 1)""".replace("{4}", "{4}")


_cyr = lambda x: "translate(" + "".join("replace(" for _ in L.CYRILLIC_MANY) + x + "".join(f", '{a}', '{b}')" for a, b in L.CYRILLIC_MANY.items()) + f", '{L.CYRILLIC_ONE[0] + L.CYRILLIC_NONE}', '{L.CYRILLIC_ONE[1]}')"


def column_name(x: str) -> str:
    spaced = rf"replace(lower(regexp_replace(trim({x}), '([a-zа-я0-9])([A-ZА-Я])', '\1 \2', 'g')), 'ё', 'е')"
    parts = f"list_transform(list_filter(regexp_split_to_array({spaced}, '[^a-zа-я0-9]+'), lambda w: w <> ''), lambda w: {_cyr('w')})"
    joined = f"(list_transform([{parts}], lambda p: p[1] || array_to_string(list_transform(p[2:], lambda w: upper(w[1]) || w[2:]), ''))[1])"
    return f"CASE WHEN regexp_matches({joined}, '^[a-z]') THEN {joined} ELSE 'field' || {joined} END"


def normal_pairs() -> str:
    kept = f"list_filter(s.canonical, lambda w: w NOT IN ({_list(L.SENSITIVE)}) AND NOT regexp_full_match(w, '[0-9]+'))"
    return f"""WITH {LOG}, {LABELS}, {NAMED}, p AS (SELECT DISTINCT source, target FROM log),
j AS (SELECT p.source AS label, p.target AS field, coalesce(nullif(array_to_string({kept}, ' '), ''), array_to_string(s.toks, '')) AS source, array_to_string(t.toks, '') AS target, list_concat(t.canonical, s.canonical) AS c, s.canonical AS sc, t.canonical AS tc, s.role AS s_role, t.role AS t_role FROM p JOIN named s ON s.label = p.source JOIN named t ON t.label = p.target),
r AS (SELECT label, field, source, target, array_to_string(list_sort(list_distinct(list_filter(c, lambda w: w IN ({_list(L.DOMAIN_TAGS)})))), ',') AS tags,
  coalesce(CASE WHEN list_has_all(c, ['created', 'date']) THEN 'created_at' WHEN list_has_all(c, ['updated', 'date']) THEN 'updated_at' WHEN list_contains(c, 'id') THEN 'identifier' WHEN list_contains(c, 'revenue') THEN 'revenue' WHEN list_contains(c, 'amount') THEN 'amount' WHEN list_contains(c, 'quantity') THEN 'quantity' WHEN list_contains(c, 'name') THEN 'label' WHEN list_contains(c, 'description') THEN 'description' WHEN list_contains(c, 'boolean') THEN 'flag' ELSE coalesce(t_role, s_role) END, '') AS role,
  coalesce(CASE WHEN list_has_all(c, ['created', 'date']) THEN 'temporal.creation' WHEN list_has_all(c, ['updated', 'date']) THEN 'temporal.update' WHEN list_contains(c, 'id') THEN 'identity.identifier' WHEN list_contains(c, 'revenue') THEN 'finance.revenue' WHEN list_has_all(c, ['amount', 'gross']) THEN 'finance.amount.gross' WHEN list_has_all(c, ['amount', 'net']) THEN 'finance.amount.net' WHEN list_contains(c, 'amount') THEN 'finance.amount' WHEN list_contains(c, 'quantity') THEN 'inventory.quantity' WHEN list_contains(c, 'organization') THEN 'entity.organization' WHEN list_contains(c, 'customer') THEN 'entity.customer' WHEN list_contains(c, 'product') THEN 'entity.product' WHEN list_contains(c, 'name') THEN 'identity.name' WHEN list_contains(c, 'description') THEN 'text.description' WHEN list_contains(c, 'creator') THEN 'ownership.creator' WHEN list_contains(c, 'responsible') THEN 'ownership.responsible' WHEN list_contains(c, 'source') THEN 'channel.source' WHEN list_contains(c, 'partner') THEN 'entity.partner' END, '') AS concept FROM j)
SELECT *, sha256(source || '|' || target || '|' || role || '|' || concept) AS hash FROM r"""


_weekly = STATS.replace("SELECT source, target, count(*) AS support", "SELECT date_trunc('week', ts) AS week, source, target, count(*) AS support").replace("FROM log GROUP BY source, target", "FROM log GROUP BY ALL").replace("SELECT source, target, support", "SELECT week, source, target, support")

SQL: dict[str, str] = {
    "f10_parse_values": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS number, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE 'unknown' END AS flag FROM orders",
    "f8_column_names": f"SELECT p_partkey, {column_name('p_size || chr(32) || p_type')} AS a, {column_name(chr(39) + 'Ёмкость ' + chr(39) + ' || p_brand || ' + chr(39) + ' щука' + chr(39))} AS b FROM part",
    "f18_repair_numbers": "SELECT c_custkey, printf('%.2f', c_acctbal) AS repaired, CASE WHEN c_custkey % 14 + 1 <= 12 THEN printf('2024-%02d-01', CAST(c_custkey % 14 + 1 AS INT)) END AS day FROM customer",
    "x1_key_values": "SELECT c_custkey AS doc_id, unnest([1, 2, 3, 4, 5, 6]) AS n, unnest(['Name', 'Balance', 'Segment', 'name', 'key part', 'a']) AS label, unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment, 'other', 'its value', 'b']) AS value FROM customer",
    "x5_delimited_tables": r"""WITH docs AS (SELECT c_custkey AS doc_id, 'name;segment' || chr(10) || c_name || ';' || c_mktsegment || chr(10) || chr(10) || 'no table' || chr(10) || 'here' || chr(10) || chr(10) || '|a|b|c|' || chr(10) || '|--|:---|---|' || chr(10) || '|1|2|' || chr(10) || '|4|5|' || c_nationkey || '|' || chr(10) || chr(10) || 'x  y' || chr(10) || '1   2' || chr(10) || '3  ' || c_mktsegment AS text FROM customer UNION ALL SELECT -doc_id - 1, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs),
b AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, CAST(sum(CASE WHEN regexp_matches(raw, '^\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block FROM l),
f AS (SELECT doc_id, block, list(line ORDER BY pos) AS ls FROM b WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT doc_id, block, ls, rank, d, list_transform(ls, lambda x: list_transform(CASE d WHEN '  ' THEN regexp_split_to_array(x, '\s{2,}') WHEN '|' THEN string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|') ELSE string_split(x, d) END, lambda c: trim(regexp_replace(c, '\s+', ' ', 'g')))) AS cells FROM f, (VALUES (0, chr(9)), (1, '|'), (2, ';'), (3, ','), (4, '  ')) v(rank, d)
  WHERE len(list_filter(ls, lambda x: CASE d WHEN '|' THEN len(string_split(x, '|')) < 3 WHEN '  ' THEN NOT regexp_matches(x, '\s{2,}') ELSE NOT contains(x, d) END)) = 0),
r AS (SELECT doc_id, block, rank, d, CASE WHEN d = '|' THEN list_filter(cells, lambda c: NOT (len(list_filter(c, lambda x: x <> '')) > 0 AND len(list_filter(c, lambda x: x <> '' AND NOT regexp_full_match(x, ':?-{3,}:?'))) = 0)) ELSE cells END AS rows FROM s WHERE len(list_filter(cells, lambda c: len(c) < 2)) = 0),
g AS (SELECT doc_id, block, rank, d, len(rows[1]) AS columns, len(list_filter(rows[2:], lambda c: len(list_filter(c[1:len(rows[1])], lambda x: x <> '')) > 0)) AS n FROM r WHERE len(rows) >= 2 AND len(list_filter(rows[1], lambda x: x <> '')) >= 2)
SELECT doc_id, block, d AS delimiter, CAST(columns AS INT) AS columns, n AS rows FROM g WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY columns * (n + 1) DESC, rank) = 1""",
    "m21_promotion_of_few": f"WITH {_weekly} SELECT week, source, target, g[1] AS status, g[2] AS reason FROM (SELECT *, {GATES} AS g FROM stats)",
    "m26_graph_evidence": f"WITH {EDGES}, near AS (SELECT node, other, 0.7 * accepts / (accepts + rejects) + 0.3 * mean_confidence AS score FROM both_ways), asked AS (SELECT DISTINCT n.name AS source, 'creationdate' AS target FROM log g JOIN joined_names n ON n.label = g.target WHERE n.name <> 'creationdate'), found AS (SELECT source, target, 'direct' AS path, score FROM asked JOIN near ON node = source AND other = target UNION ALL SELECT q.source, q.target, 'two_hop', 0.72 * least(a.score, b.score) FROM asked q JOIN near a ON a.node = q.source JOIN near b ON b.node = q.target AND a.other = b.other) SELECT source, target, path, score FROM found QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY score DESC, path DESC) = 1",
    "m28_graph_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT node, cluster FROM member",
    "m28_cluster_summary": f"WITH RECURSIVE {CLUSTERS}, {NAMED}, m AS (SELECT DISTINCT array_to_string(toks, '') AS node, attribute, role, entity FROM named), listed AS (SELECT cluster, count(DISTINCT node) AS size, array_to_string(list_sort(list(DISTINCT attribute) FILTER (attribute IS NOT NULL)), ',') AS attributes, coalesce(array_to_string(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), ','), '') AS roles, coalesce(array_to_string(list_sort(list(DISTINCT entity) FILTER (entity IS NOT NULL)), ','), '') AS entities FROM member LEFT JOIN m USING (node) GROUP BY cluster), s AS (SELECT cluster, CAST(sum(accepts + rejects) AS BIGINT) AS support FROM live JOIN member ON node = l GROUP BY cluster) SELECT * FROM listed JOIN s USING (cluster)",
    "l3_line_zones": f"WITH {ZONED} SELECT doc_id, zone, count(*) AS n FROM zoned GROUP BY 1, 2",
    "w6_region_zones": f"WITH {ZONED} SELECT doc_id, region, v.z AS zone, CAST(v.s AS DOUBLE) AS score, lines FROM regions",
    "l3_page_classes": f"WITH {ZONED}, c AS (SELECT doc_id, CAST(0 AS BIGINT) AS n_table, count(*) FILTER (v.z = 'form') AS n_form, count(*) FILTER (v.z = 'text') AS n_text, count(*) FILTER (v.z = 'noise') AS n_noise FROM regions GROUP BY doc_id) SELECT *, CASE WHEN n_form >= n_text AND n_form >= n_noise THEN 'form' WHEN n_text >= n_noise THEN 'text' ELSE 'noise' END AS dominant, CASE WHEN n_form > 0 THEN 'form' ELSE 'text' END AS content_type FROM c",
    "w8_line_segments": "WITH d AS (SELECT doc_id, replace(text, '. ', '.           ') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM d), w AS (SELECT doc_id, line, unnest(string_split(content, ' ')) AS t, unnest(range(len(string_split(content, ' ')))) AS pos FROM l WHERE content <> ''), x AS (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos) - length(t) - 1) * 7.0 AS x, length(t) * 7.0 AS width FROM w), y AS (SELECT *, CASE WHEN x - lag(x + width) OVER (PARTITION BY doc_id, line ORDER BY x) > 60 THEN 1 ELSE 0 END AS new FROM x WHERE t <> ''), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, line ORDER BY x) AS BIGINT) AS segment FROM y) SELECT doc_id, CAST(line AS INT) AS line, segment, CAST(min(x) AS DOUBLE) AS x0, CAST(max(x + width) AS DOUBLE) AS x1, count(*) AS n_words FROM s GROUP BY 1, 2, 3",
    "p18_best_row_group": "WITH r AS (SELECT event_id, array_to_string(list_filter([CASE WHEN event_type <> 'error' THEN 'kind' END, CASE WHEN value > 30 THEN 'net_amount' END, CASE WHEN user_id % 2 = 0 THEN 'owner' END], lambda x: x IS NOT NULL), '|') AS signature FROM events), g AS (SELECT signature, count(*) AS n, CASE WHEN contains(signature, 'kind') THEN 5 ELSE 0 END + CASE WHEN contains(signature, 'net_amount') THEN 4 ELSE 0 END AS score FROM r GROUP BY signature) SELECT event_id, signature FROM r WHERE signature = (SELECT signature FROM g ORDER BY score DESC, n DESC, signature DESC LIMIT 1)",
    "a20_column_types": f'WITH {OCR_TYPES} SELECT "table", col, type FROM types',
    "l6_repaired_cells": f"""WITH {OCR_TYPES}, done AS (SELECT o."table", o.col, type, CASE type WHEN 'number' THEN CASE WHEN {_is_number} THEN replace({_number}, ',', '.') ELSE '' END WHEN 'date' THEN strftime({_day}, '%Y-%m-%d') ELSE CASE WHEN contains(value, 'Хoлoд') THEN CASE WHEN length(regexp_replace(value, '[^a-zA-Z]', '', 'g')) > 3 THEN translate(value, '{V.CYRILLIC_ALIKE}', '{V.LATIN_ALIKE}') ELSE translate(value, '{V.LATIN_ALIKE}', '{V.CYRILLIC_ALIKE}') END ELSE value END END AS repaired FROM ocr o JOIN types t ON t."table" = o."table" AND t.col = o.col) SELECT "table", col, type, count(*) FILTER (repaired = '') AS empty, min(repaired) AS least, max(repaired) AS most FROM done GROUP BY 1, 2, 3""",
    "a21_repeated_width": f"WITH {FLAT} SELECT doc_id, CAST(width AS BIGINT) AS width, score FROM best",
    "a22_repeated_columns": f"WITH {FLAT}, named AS (SELECT c.doc_id, c.col, CASE kind WHEN 'identifier' THEN 'identifier' WHEN 'date' THEN 'date' WHEN 'number' THEN 'amount' WHEN 'organization' THEN 'organization' WHEN 'person' THEN 'responsible' ELSE CASE WHEN c.width >= 6 AND c.col = 1 THEN 'name' WHEN c.width >= 6 AND c.col = 3 THEN 'stage' ELSE 'column' || (c.col + 1) END END AS name FROM cols c JOIN best b ON b.doc_id = c.doc_id AND b.width = c.width), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY col) AS n FROM named) SELECT doc_id, CAST(col AS BIGINT) AS \"column\", CASE WHEN n = 1 THEN name ELSE name || n END AS name FROM numbered",
    "sc13_delimiters": "WITH o AS (SELECT doc_id, array_to_string(list_transform(range(1, len(string_split(text, '\"')) + 1, 2), lambda i: string_split(text, '\"')[i]), '') AS t FROM documents), n AS (SELECT doc_id, [len(string_split(t, ';')), len(string_split(t, chr(9))), len(string_split(t, ',')), len(string_split(t, '|'))] AS n FROM o) SELECT doc_id, [';', chr(9), ',', '|'][list_position(n, list_max(n))] AS delimiter FROM n",
    "sc9_usable_text": r"WITH p AS (SELECT lang, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS plain FROM documents) SELECT lang, (length(plain) >= 80 OR len(list_filter(string_split(plain, chr(10)), lambda x: trim(x) <> '')) >= 3) AND len(regexp_extract_all(text, '[\x{FFFD}\x00-\x08]')) / greatest(1, length(text)) <= 0.01 AND len(regexp_extract_all(text, '[\p{L}\p{N}]')) >= 40 AS usable, count(*) AS n FROM p GROUP BY 1, 2",
    "p16_token_users": f"WITH {LOG}, w AS (SELECT DISTINCT user_id, unnest(string_split(source, ' ')) AS token FROM log) SELECT token, count(DISTINCT user_id) AS users FROM w WHERE token IN ('customer', 'amount', 'date', 'revenue', 'phone') GROUP BY token",
    "f9_placeholders": "SELECT o_orderkey % 5 <> 2 AS placeholder, o_orderkey % 5 < 3 AS visible, count(*) AS n FROM orders GROUP BY 1, 2",
    "f14_representatives": """WITH n AS (SELECT user_id, count(*) AS n, arg_min(json_extract_string(props, '$.k'), event_id) FILTER (event_id % 3 = 0) AS k, count(*) FILTER (event_id % 3 = 0) AS nk, arg_min(event_type, event_id) FILTER (event_id % 29 = 0) AS rare, count(*) FILTER (event_id % 29 = 0) AS nr, arg_min(event_type, event_id) FILTER (event_id % 2 <> 0) AS kind, strftime(arg_min(ts, event_id), '%Y-%m-%d') AS day, count(*) FILTER (value <= 50) AS yes FROM events GROUP BY user_id)
SELECT user_id, unnest(['k', 'rare', 'type', 'day', 'flag']) AS "column", unnest([CASE WHEN n >= 5 AND nk / n <= 0.1 THEN NULL ELSE k END, CASE WHEN n >= 5 AND nr / n <= 0.1 THEN NULL ELSE rare END, kind, day, CASE WHEN yes > 0 THEN 'true' END]) AS value FROM n""",
    "f19_one_script": f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND 6 >= length(c_mktsegment) + 1 THEN translate('Хoлдинг ' || c_mktsegment, '{V.LATIN_ALIKE}', '{V.CYRILLIC_ALIKE}') WHEN c_custkey % 2 = 0 THEN translate('Хoлдинг ' || c_mktsegment, '{V.CYRILLIC_ALIKE}', '{V.LATIN_ALIKE}') ELSE 'Corp ' || c_mktsegment END AS value FROM customer",
    "f25_cleaned_names": f"WITH n AS (SELECT p_partkey, {meanings(tokens(chr(39) + 'Email клиента ' + chr(39) + ' || p_type || chr(32) || p_partkey'))} AS c FROM part) SELECT p_partkey, array_to_string(list_filter(c, lambda w: w NOT IN ({_list(L.SENSITIVE)}) AND NOT regexp_full_match(w, '[0-9]+')), ' ') AS cleaned FROM n",
    "f33_headers": "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'Column ' || p_size ELSE p_brand END AS header FROM part",
    "f34_residency": "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'NOWHERE' WHEN c_nationkey < 10 THEN 'YES' WHEN c_nationkey < 15 THEN 'NO' WHEN c_nationkey < 20 THEN 'NOWHERE' ELSE 'none' END AS answer FROM customer",
    "f23_phrase_similarity": r"WITH w AS (SELECT p_partkey, regexp_split_to_array(lower(p_type), '[^a-z0-9]+') AS a, regexp_split_to_array(lower(p_name), '[^a-z0-9]+') AS b, regexp_split_to_array(lower(regexp_replace(p_type, '^[A-Z]+ ', '')), '[^a-z0-9]+') AS c FROM part), s AS (SELECT p_partkey, array_to_string(a, ' ') AS ta, array_to_string(b, ' ') AS tb, array_to_string(c, ' ') AS tc, len(list_intersect(a, b)) / greatest(len(list_distinct(a)), len(list_distinct(b))) AS ab, len(list_intersect(a, c)) / greatest(len(list_distinct(a)), len(list_distinct(c))) AS ac FROM w) SELECT p_partkey, round(CASE WHEN ta = tb THEN 1.0 ELSE least(1.0, ab + CASE WHEN contains(ta, tb) OR contains(tb, ta) THEN 0.15 ELSE 0 END) END, 6) AS names, round(CASE WHEN ta = tc THEN 1.0 ELSE least(1.0, ac + CASE WHEN contains(ta, tc) OR contains(tc, ta) THEN 0.15 ELSE 0 END) END, 6) AS shorter FROM s",
    "m48_normal_pairs": normal_pairs(),
    "x6_markdown_rows": "SELECT c_custkey AS doc_id, r AS row, col AS \"column\", CASE WHEN r = 1 AND col = 'name' THEN c_name WHEN r = 1 THEN c_mktsegment WHEN col = 'name' THEN 'a' ELSE 'b' END AS value FROM customer, (VALUES (1, 'name'), (1, 'segment'), (2, 'name'), (2, 'segment')) v(r, col) WHERE c_nationkey <= 20",
    "sc15_quoted_cells": "SELECT c_custkey, c_name || ', the \"first\"~' || c_mktsegment || '~~x' AS cells, 4 AS n FROM customer",
    "p8_codes": r"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN length(p_brand) <= 16 AND upper(p_brand) = p_brand AND regexp_matches(p_brand, '\d') ELSE length('A-' || p_partkey) <= 16 END AS code FROM part",
    "p9_useful_labels": "WITH v AS (SELECT o_orderpriority, o_orderkey % 4 AS k, regexp_replace('X ' || o_orderpriority, '[^A-Za-z]', '', 'g') AS letters FROM orders) SELECT o_orderpriority, k = 3 OR (k = 1 AND NOT (length(letters) >= 8 AND upper(letters) = letters)) AS useful, count(*) AS n FROM v GROUP BY 1, 2",
    "u7_deduped": """
SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN l_quantity > 25 THEN 'kv_pair' ELSE 'text_fact' END AS type, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS label, CASE WHEN l_quantity > 10 THEN l_linestatus ELSE 'none' END AS value
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_quantity > 25, lower(l_returnflag), CASE WHEN l_quantity > 10 THEN lower(l_linestatus) ELSE '' END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1
""",
    "a1_learning_counts": f"WITH {SUGGESTIONS}, {MEMORY}, n AS (SELECT user_id, count(*) AS mapping_suggestions, count(*) FILTER (status <> 'suggested') AS user_corrections, count(*) FILTER (truth = 'model_suggestion') AS model_based, count(*) FILTER (truth = 'model_suggestion' AND status = 'accepted') AS model_accepted, count(*) FILTER (truth = 'model_suggestion' AND status = 'rejected') AS model_rejected, count(DISTINCT run_id) AS runs FROM sug GROUP BY user_id), m AS (SELECT user_id, count(*) AS mapping_memory FROM memory GROUP BY user_id) SELECT n.*, CASE WHEN model_accepted + model_rejected > 0 THEN model_accepted / (model_accepted + model_rejected) END AS model_acceptance, coalesce(mapping_memory, 0) AS mapping_memory FROM n LEFT JOIN m USING (user_id)",
    "a2_staging_counts": f"WITH {SUGGESTIONS} SELECT user_id, count(*) FILTER (status = 'suggested') AS pending, count(*) FILTER (status = 'rejected') AS rejected, count(*) AS total FROM sug WHERE status IN ('suggested', 'rejected') GROUP BY user_id",
    "t1_staging_list": f"WITH {SUGGESTIONS}, s AS (SELECT user_id, source, target, truth, status, count(*) AS seen, max(confidence) AS max_confidence, max(ts) AS last_seen FROM sug WHERE source IS NOT NULL AND status IN ('suggested', 'rejected') GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY status <> 'suggested', last_seen DESC, source, target, truth) AS INT) AS rank FROM s) WHERE rank <= 5",
    "m29_memory_layers": f"""WITH {PATTERNS}, {SUGGESTIONS.replace(LOG, '').lstrip(', ')}, {MEMORY}, {USER_EDGES}
SELECT user_id, 'staging' AS layer, unnest(['pending', 'rejected', 'total']) AS kind, unnest([count(*) FILTER (status = 'suggested'), count(*) FILTER (status = 'rejected'), count(*)]) AS n FROM sug WHERE status IN ('suggested', 'rejected') GROUP BY user_id
UNION ALL SELECT user_id, 'personal', unnest(['entries', 'accepted', 'rejected']), unnest([count(*), CAST(sum(success_count) AS BIGINT), CAST(sum(failure_count) AS BIGINT)]) FROM memory GROUP BY user_id
UNION ALL SELECT user_id, 'graph', unnest(['edges', 'accepted', 'rejected']), unnest([count(*), CAST(sum(accepts) AS BIGINT), CAST(sum(rejects) AS BIGINT)]) FROM user_edges GROUP BY user_id
UNION ALL SELECT -1, 'shared', unnest(['patterns', 'personal_only', 'shared_candidate', 'shared_promoted', 'blocked_sensitive']), unnest([count(*), count(*) FILTER (status = 'personal_only'), count(*) FILTER (status = 'shared_candidate'), count(*) FILTER (status = 'shared_promoted'), count(*) FILTER (status = 'blocked_sensitive')]) FROM patterns""",
    "j5_touched_nodes": f"WITH {LOG}, {LABELS}, {USER_EDGES} SELECT user_id, count(DISTINCT node) AS nodes FROM (SELECT user_id, l AS node FROM user_edges UNION SELECT user_id, r FROM user_edges) GROUP BY user_id",
    "t3_remembered": f"WITH {LOG}, {MEMORY} SELECT user_id, source, target, schema_match, success_count, rank FROM (SELECT *, CAST(target IN ('amount', 'name') AS INT) AS schema_match, CAST(row_number() OVER (PARTITION BY user_id ORDER BY target IN ('amount', 'name') DESC, success_count DESC, weight DESC, last_used DESC, source, target) AS INT) AS rank FROM memory) WHERE rank <= 4",
    "j11_shared_lookup": f"WITH {PATTERNS} SELECT source, target, status, support, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(starts_with(concept, 'finance'), false) DESC, status = 'shared_promoted' DESC, acceptance DESC, support DESC, users DESC, target) AS INT) AS rank FROM patterns WHERE status IN ('shared_promoted', 'shared_candidate') AND (source, target) IN (SELECT source, target FROM log WHERE confidence > 0.8)) WHERE rank <= 3",
    "j12_promotable": f"WITH {PATTERNS} SELECT source, target, status, acceptance FROM patterns WHERE status IN ('shared_candidate', 'shared_promoted') AND support >= 3 AND users >= 2 AND acceptance >= 0.5 AND drift <= 0.5",
    "p15_active_tokens": "SELECT DISTINCT CASE WHEN c_nationkey < 3 THEN -1 ELSE c_custkey END AS user_id, lower(c_mktsegment) AS token FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20",
    "j15_run_counts": "SELECT c_custkey, count(o_orderkey) AS runs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "m12_final_confidence": "WITH f AS (SELECT event_id, value, CASE WHEN event_id % 4 = 0 THEN least(1.0, greatest(0.0, value / 80)) ELSE least(1.0, greatest(0.0, 0.72 * least(1.0, greatest(0.0, value / 80)) + 0.28 * (event_id % 100) / 100 - 0.25 * CASE WHEN event_id % 10 = 0 THEN 0.72 ELSE 0.0 END)) END AS x FROM events) SELECT event_id, round(x, 6) AS final, CASE WHEN event_id % 13 = 0 THEN 'model_returned_no_candidate' WHEN event_id % 17 = 0 THEN 'source_already_used' WHEN event_id % 10 = 0 THEN 'amount_vs_revenue' WHEN x < 0.68 AND value / 80 < 0.4 THEN 'low_final_confidence' WHEN x < 0.68 THEN 'below_acceptance_threshold' ELSE 'accepted' END AS reason FROM f",
    "m13_routed": "WITH m AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'PDF' ELSE 'csv' END AS file_type, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS band, l_discount AS score, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber NOT IN (1, 6) THEN CASE WHEN l_partkey % 2 = 0 THEN 0.22 WHEN l_partkey % 3 = 0 THEN 0.12 ELSE 0.0 END ELSE 0.0 END AS penalty FROM lineitem) SELECT file_type, band, CASE WHEN penalty = 0.22 OR (penalty = 0.12 AND band <> 'high') THEN 'low' WHEN penalty = 0.12 THEN 'medium' ELSE band END AS new_band, CAST(penalty AS DOUBLE) AS penalty, count(*) AS n, round(sum(CASE WHEN penalty > 0 THEN greatest(0.0, score - penalty) ELSE score END), 4) AS score FROM m GROUP BY 1, 2, 3, 4",
    "w2_picked": "SELECT l_orderkey AS case_id, CAST(l_linenumber % 2 AS VARCHAR) AS target, 's' || l_partkey AS source, l_discount AS score FROM lineitem WHERE l_returnflag <> 'R' AND l_discount >= 0.04 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_discount DESC, l_tax DESC, 's' || l_partkey DESC) = 1",
    "m27_context_fit": f"WITH {LOG}, {LABELS}, {NAMED}, p AS (SELECT source, target, count(*) AS n FROM log GROUP BY 1, 2) SELECT source, target, n, CAST(CASE WHEN s.attribute = t.attribute THEN CASE WHEN s.entity = t.entity THEN 0.28 WHEN s.entity IS NULL OR t.entity IS NULL THEN 0.12 ELSE -0.18 END WHEN s.role = t.role THEN CASE WHEN s.entity = t.entity THEN 0.16 WHEN s.entity IS NULL OR t.entity IS NULL THEN 0.08 ELSE -0.14 END ELSE 0.0 END AS DOUBLE) AS fit FROM p JOIN named s ON s.label = source JOIN named t ON t.label = target",
    "j14_snapshot_runs": "WITH s AS (SELECT dayofyear(ts) AS w, count(*) AS items FROM events WHERE value / 100 >= 0.72 GROUP BY 1) SELECT coalesce(items, -1) AS items, count(*) AS runs FROM orders LEFT JOIN s ON w = dayofyear(o_orderdate) GROUP BY 1",
    "w17_form_groups": "SELECT c_custkey AS doc_id, q AS question, o AS option, CASE o WHEN 'early' THEN true WHEN 'Other' THEN c_nationkey > 12 ELSE c_mktsegment = o END AS selected, CASE WHEN CASE o WHEN 'early' THEN true WHEN 'Other' THEN c_nationkey > 12 ELSE c_mktsegment = o END THEN 0.96 ELSE 0.88 END::DOUBLE AS confidence FROM customer, (VALUES ('Unknown question', 'early'), ('Which segment? Pick one', 'BUILDING'), ('Which segment? Pick one', 'MACHINERY'), ('Which segment? Pick one', 'Other'), ('Which segment? Pick one', 'stray'), ('Any of these apply:', 'first'), ('Any of these apply:', 'second')) v(q, o)",
    "l16_form_answers": "SELECT c_custkey AS doc_id, 'Which segment? Pick one' AS question, CASE WHEN c_nationkey > 12 THEN 'ambiguous' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'single' ELSE 'not_found' END AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '' END AS answer, CASE WHEN c_nationkey > 12 THEN 0.45 WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0.92 ELSE 0.0 END AS confidence FROM customer UNION ALL SELECT c_custkey, 'Any of these apply:', 'not_found', '', 0.0 FROM customer UNION ALL SELECT c_custkey, 'Unknown question', 'ambiguous', '', 0.45 FROM customer",
    "m18_draft_names": f"WITH {STATS}, m AS (SELECT user_id, source, target, least(1.0, 0.55 * avg(confidence) + 0.25 * count(*) FILTER (accepted) / count(*) + 0.1 * least(count(*) / 4, 1.0)) AS score FROM log GROUP BY 1, 2, 3), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, source ORDER BY score DESC, target DESC) = 1), s AS (SELECT source, target AS shared, least(1.0, 0.35 * mean_confidence + 0.35 * acceptance + 0.2 * least(support / 5, 1.0) + 0.1 * least(users / 3, 1.0)) AS shared_score FROM stats WHERE sensitivity < 0.6 QUALIFY row_number() OVER (PARTITION BY source ORDER BY least(1.0, 0.35 * mean_confidence + 0.35 * acceptance + 0.2 * least(support / 5, 1.0) + 0.1 * least(users / 3, 1.0)) DESC, target DESC) = 1), w AS (SELECT b.*, shared, shared_score, string_split(b.source, ' ') AS p FROM b LEFT JOIN s ON s.source = b.source) SELECT user_id, source, CASE WHEN user_id % 3 = 0 AND score >= 0.6 THEN target WHEN user_id % 3 = 1 AND shared_score >= 0.7 THEN shared ELSE p[1] || array_to_string(list_transform(p[2:], lambda x: upper(x[1]) || x[2:]), '') END AS name FROM w",
    "p4_expected_sources": "WITH m AS (SELECT l_suppkey AS case_id, l_returnflag || ' ' || l_linestatus AS source, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2) SELECT case_id, string_agg(source, ',' ORDER BY pos, source) AS sources FROM m GROUP BY case_id",
    "p13_usable_previews": "WITH r AS (SELECT l_orderkey AS t, l_quantity > 40 AND NOT l_discount > 0.05 AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey) AS n FROM lineitem) SELECT t AS \"table\", bool_or(good AND n <= 5) AS usable FROM r GROUP BY t",
    "p17_found_events": """SELECT event_id FROM events WHERE event_type = 'click' AND contains(lower('Event ' || user_id || ' ' || props), '"k": 1')""",
    "a24_stage_counts": "SELECT count(*) AS \"all\", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'signup') AS signup FROM events",
    "w7_zone_edges": "WITH z AS (SELECT DISTINCT l_orderkey AS page, l_linenumber % 3 AS col, l_quantity AS y, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM lineitem), n AS (SELECT *, lead(id) OVER (PARTITION BY page, col ORDER BY y, id) AS nxt FROM z), e AS (SELECT page, id AS f, nxt AS t, 'next_in_column' AS relation FROM n WHERE nxt IS NOT NULL UNION ALL SELECT n.page, n.id, z.id, 'adjacent_column' FROM n JOIN z ON z.page = n.page AND z.col > n.col WHERE nxt IS NULL) SELECT page, relation, count(*) AS n, min(f) AS least_from, max(t) AS most_to FROM e GROUP BY 1, 2",
    "t6_reading_order": "SELECT event_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 7 <> 0 THEN event_id % 3 ELSE 0 END, event_id % 2, value, event_id) AS INT) AS place FROM events",
    "u4_united_sheets": "WITH s AS (SELECT o_custkey AS book, o_orderpriority AS sheet, min(o_orderkey) AS pos, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1, 2), g AS (SELECT book, count(*) AS sheets, count(*) FILTER (n > 0) AS filled, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, coalesce(list(sheet ORDER BY pos) FILTER (n > 0), []) AS names FROM s GROUP BY book) SELECT book, array_to_string(list_concat(CASE WHEN filled > 0 THEN ['key'] ELSE [] END, list_transform(names, lambda x: 'c' || x[1])), ',') AS columns, rows, CASE WHEN filled > 1 THEN 'Merged ' || filled || ' sheets: ' || array_to_string(names, ', ') WHEN filled = 1 AND sheets > 1 THEN 'Workbook has multiple sheets. Used the only non-empty sheet: ' || names[1] ELSE 'none' END AS warning FROM g",
    "a16_routing_adjustment": "WITH m AS (SELECT l_orderkey AS case_id, l_returnflag AS target, CASE l_linenumber % 3 WHEN 0 THEN 'weak' WHEN 1 THEN '' ELSE l_linestatus END AS reason, l_discount AS penalty FROM lineitem) SELECT case_id, count(*) AS adjusted, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons, count(DISTINCT target) AS targets, max(penalty) AS strongest FROM m WHERE reason <> '' GROUP BY case_id",
    "a17_group_signals": "WITH g AS (SELECT l_orderkey AS doc_id, 'g' || l_linenumber AS id, l_returnflag = 'R' AS amb, coalesce(l_linenumber <> 2 AND l_tax * 10 < 0.6, false) OR l_discount * 10 < 0.6 AS low FROM lineitem) SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (amb)), ','), '') AS ambiguous_groups, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (NOT amb AND low)), ','), '') AS low_confidence_groups FROM g GROUP BY doc_id",
    "a23_table_zones": "WITH r AS (SELECT event_id % 97 AS t, CASE WHEN event_id % 97 % 4 = 0 THEN 1 ELSE 0 END AS marks, 1 + CASE WHEN event_id % 97 % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 97 % 5 = 0 THEN 1 ELSE 0 END AS filled, 1 + CASE WHEN event_id % 97 % 3 <> 0 THEN 1 ELSE 0 END AS short FROM events), g AS (SELECT t, count(*) AS rows, avg(filled / 3.0) AS fill, sum(marks) AS marks, sum(short) AS short, count(*) FILTER (filled >= 2) AS whole, t % 2 = 0 AS asks FROM r GROUP BY t), s AS (SELECT t, CASE WHEN rows >= 2 THEN 0.25 ELSE 0 END + CASE WHEN whole >= greatest(2, rows // 2) THEN 0.25 ELSE 0 END + CASE WHEN fill >= 0.55 THEN 0.2 ELSE 0 END + CASE WHEN NOT asks THEN 0.15 ELSE 0 END AS data, CASE WHEN marks > 0 THEN 0.35 ELSE 0 END + CASE WHEN fill <= 0.6 THEN 0.2 ELSE 0 END + CASE WHEN asks THEN 0.2 ELSE 0 END + CASE WHEN short >= greatest(4, rows) THEN 0.15 ELSE 0 END AS form FROM g) SELECT t AS \"table\", CASE WHEN form >= data AND form >= 0.35 THEN 'form' WHEN data >= 0.35 THEN 'table' ELSE 'noise' END AS zone, CAST(round(CASE WHEN form >= data AND form >= 0.35 THEN form WHEN data >= 0.35 THEN data ELSE greatest(data, form, 0.1) END, 4) AS DOUBLE) AS score FROM s",
    "f30_model_usage": "SELECT event_id AS id, user_id AS prompt_tokens, CAST(CASE WHEN event_id % 5 = 1 THEN 8 ELSE 0 END AS BIGINT) AS completion_tokens, CASE WHEN event_id % 5 = 1 THEN user_id + 8 WHEN event_id % 3 > 0 THEN event_id % 3 ELSE user_id END AS total_tokens, CAST(CASE WHEN event_id % 5 = 1 THEN 3 ELSE 0 END AS BIGINT) AS precached_prompt_tokens FROM events WHERE event_id % 5 <> 0",
    "m11_sample_values": "SELECT o_custkey, 'flag' AS \"column\", arg_min(o_orderstatus, o_orderkey) AS sample FROM orders WHERE o_orderkey % 4 = 0 GROUP BY o_custkey UNION ALL SELECT o_custkey, 'o_orderpriority', arg_min(o_orderpriority, o_orderkey) FROM orders GROUP BY o_custkey",
}
