"""DuckDB SQL of lines on pages: marks, wrapped options and groups, each walked line by line."""

from __future__ import annotations

from fieldweave.plans.form_sql import GROUPS as GROUPS_OF_TABLES

LINES = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
lines AS (
  SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id AS BIGINT) AS pos,
    ['Which of these parts apply to the client?', 'Which of the following statements are true here?', 'X paid in part', '[ ] not paid at all', '(and so on)', 'Yes, with a note', 'X', 'Sum: of it', 'plain words here', 'Also the rest', '', '☐'][(event_id * 7 + CAST(floor(value) AS BIGINT)) % 12 + 1] AS text,
    n // 25 AS page, CAST(CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN 2 ELSE 1 END AS BIGINT) AS column_id, CAST((n % 25) * 4 AS DOUBLE) AS y, CAST(floor(value / 4) * 4 AS DOUBLE) AS x
  FROM numbered
)"""

#: the nearest text of each mark that no earlier mark of the page has
MARKED = """
marks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, pos) AS k FROM lines WHERE text IN ('X', '☐')),
near AS (
  SELECT m.doc_id, m.page, m.k, t.pos, row_number() OVER (PARTITION BY m.doc_id, m.page, m.k ORDER BY abs(t.y - m.y) + (t.x - m.x) / 100, t.y, t.x, t.pos) AS place
  FROM marks m JOIN lines t ON t.doc_id = m.doc_id AND t.page = m.page AND t.text NOT IN ('X', '☐', '') AND (t.y, t.x, t.pos) > (m.y, m.x, m.pos) AND abs(t.y - m.y) <= 6 AND t.x - m.x BETWEEN 0 AND 256
), choices AS (SELECT m.doc_id, m.page, m.k, coalesce(list(n.pos ORDER BY place) FILTER (n.pos IS NOT NULL), []) AS wanted FROM marks m LEFT JOIN near n USING (doc_id, page, k) GROUP BY ALL),
greedy AS (
  SELECT doc_id, page, k, wanted[1] AS got, CASE WHEN len(wanted) > 0 THEN wanted[1:1] ELSE [] END AS used FROM choices WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.page, c.k, list_filter(c.wanted, lambda p: NOT list_contains(g.used, p))[1], list_concat(g.used, list_filter(c.wanted, lambda p: NOT list_contains(g.used, p))[1:1])
  FROM greedy g JOIN choices c ON c.doc_id = g.doc_id AND c.page = g.page AND c.k = g.k + 1
), marked AS (
  SELECT l.doc_id, l.pos, CASE WHEN m.pos IS NULL THEN l.text ELSE m.text || ' ' || l.text END AS text, l.page, coalesce(l.column_id, m.column_id) AS column_id, l.y, least(l.x, coalesce(m.x, l.x)) AS x
  FROM lines l LEFT JOIN (greedy g JOIN marks m USING (doc_id, page, k)) ON g.doc_id = l.doc_id AND g.got = l.pos
  WHERE NOT EXISTS (SELECT 1 FROM greedy h JOIN marks o USING (doc_id, page, k) WHERE h.got IS NOT NULL AND o.doc_id = l.doc_id AND o.pos = l.pos)
)"""

_HEAD = r"(regexp_matches(text, '^\s*[XxVv✓✔☒☑□☐○◯Iil|/\\Oo]\s*.+$') OR regexp_matches(text, '^\s*\[[XxVv✓✔Iil|/\\Oo ]\]\s*.+$'))"


def flags(source: str, name: str) -> str:
    """``name``: the lines of ``source`` in reading order (k) with what each of them is."""
    return rf"""
{name} AS (
  SELECT *, words[1] IN ('да', 'нет', 'yes', 'no', 'не') AND len(words) > 0 AND NOT suffix(text, '?') AS starts,
    NOT coalesce(words[1] IN ('да', 'нет', 'yes', 'no', 'не') AND NOT suffix(text, '?'), false) AND ((contains(text, '?') AND len(words) >= 3) OR (len(words) >= 5 AND length(text) >= 24)) AS asks,
    regexp_matches(text, '^[^:]{{2,80}}:\s*.+$') AS pair, coalesce(words[1] IN ('да', 'нет', 'yes', 'no'), false) AS answers,
    text <> '' AND NOT coalesce(words[1] IN ('да', 'нет', 'yes', 'no', 'не') AND NOT suffix(text, '?'), false) AND len(words) <= 8 AND regexp_matches(text, '^[\p{{Lu}}(/\-]') AS fragment
  FROM (
    SELECT *, {_HEAD} AS option, regexp_extract_all(lower(text), '[a-zа-я0-9]+') AS words,
      row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0), coalesce(column_id, 0), coalesce(y, 0), coalesce(x, 0), pos) AS k
    FROM {source}
  )
)"""


def unwrapped(source: str) -> str:
    return f"""
{flags(source, 'told')}, wrap AS (
  SELECT doc_id, k, text, option, page, column_id, y, x, pos, CAST(0 AS BOOLEAN) AS goes_on FROM told WHERE k = 1
  UNION ALL
  SELECT doc_id, k, text, CASE WHEN goes_on THEN was_option ELSE option END, CASE WHEN goes_on THEN hp ELSE page END, CASE WHEN goes_on THEN hc ELSE column_id END, CASE WHEN goes_on THEN hy ELSE y END, CASE WHEN goes_on THEN hx ELSE x END, CASE WHEN goes_on THEN hpos ELSE pos END, goes_on
  FROM (
    SELECT t.*, w.option AS was_option, w.page AS hp, w.column_id AS hc, w.y AS hy, w.x AS hx, w.pos AS hpos,
      w.option AND NOT (t.option OR coalesce(t.starts, false) OR t.asks OR t.pair OR t.text = '') AND t.page IS NOT DISTINCT FROM w.page AND coalesce(t.column_id = w.column_id, true) AND t.y - w.y <= 14 AND abs(t.x - w.x) <= 96 AS goes_on
    FROM wrap w JOIN told t ON t.doc_id = w.doc_id AND t.k = w.k + 1
  )
), unwrapped AS (
  SELECT doc_id, pos, string_agg(text, ' ' ORDER BY k) AS text, any_value(page) AS page, any_value(column_id) AS column_id, any_value(y) AS y, any_value(x) AS x FROM wrap GROUP BY doc_id, pos HAVING text <> ''
)"""


_OTHER = "(t.page IS NOT NULL AND g.gpage IS NOT NULL AND t.page <> g.gpage)"
_CROSS = "(t.column_id IS NOT NULL AND g.gcol IS NOT NULL AND t.column_id <> g.gcol)"
_MANY = "contains(array_to_string(regexp_extract_all(lower(g.question), '[a-zа-я0-9]+'), ' '), 'following statements')"
_LISTS = f"""(g.open AND NOT t.pair AND len(t.words) BETWEEN 2 AND 18 AND NOT {_OTHER} AND NOT coalesce(g.listed AND t.column_id <> g.lcol, false) AND CASE
  WHEN {_CROSS} THEN true WHEN coalesce(t.column_id = g.gcol, false) AND NOT (g.listed AND g.lcol IS NOT NULL) THEN coalesce(t.starts, false)
  WHEN t.asks THEN false ELSE {_MANY} OR t.answers OR g.listed END)"""
_NEAR = "(NOT t.asks AND NOT t.pair AND coalesce(t.page = g.lpage, true) AND coalesce(t.column_id = g.lcol, true) AND abs(t.y - g.ly) <= 14 AND abs(t.x - g.lx) <= 96)"
_GOES_ON = f"(g.open AND g.listed AND CASE WHEN {_NEAR} THEN NOT g.lmark AND NOT coalesce(t.starts, false) ELSE {_MANY} AND t.fragment END)"

#: open: a group is open; listed: it has an option, the last of which is at l...; lmark: that one has a mark
GROUPS = f"""
{flags('unwrapped', 'read')}, fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, false AS open, 0 AS number, '' AS question, CAST(NULL AS BIGINT) AS gpage, CAST(NULL AS BIGINT) AS gcol, false AS listed, CAST(NULL AS BIGINT) AS lpage, CAST(NULL AS BIGINT) AS lcol, CAST(0 AS DOUBLE) AS ly, CAST(0 AS DOUBLE) AS lx, false AS lmark, '' AS role, CAST(0 AS BIGINT) AS pos, '' AS text
  FROM (SELECT DISTINCT doc_id FROM read)
  UNION ALL
  SELECT doc_id, k, kept OR role IN ('lists', 'new'), CASE WHEN role = 'new' OR (role = 'lists' AND NOT kept) THEN number + 1 ELSE number END,
    CASE WHEN role = 'new' THEN text WHEN role = 'lists' AND NOT kept THEN 'Unknown question' WHEN role = 'asks' THEN question || ' ' || text ELSE question END,
    CASE WHEN role = 'new' OR (role = 'lists' AND NOT kept) THEN page ELSE gpage END, CASE WHEN role = 'new' OR (role = 'lists' AND NOT kept) THEN column_id ELSE gcol END,
    CASE WHEN role = 'lists' THEN true WHEN role = 'new' OR NOT kept THEN false ELSE listed END, CASE WHEN role = 'lists' THEN page ELSE lpage END, CASE WHEN role = 'lists' THEN column_id ELSE lcol END, CASE WHEN role = 'lists' THEN y ELSE ly END, CASE WHEN role = 'lists' THEN x ELSE lx END,
    CASE WHEN role = 'lists' THEN option AND NOT starts_with(text, '[ ]') ELSE lmark END, role, pos, text
  FROM (
    SELECT *, CASE WHEN lists THEN 'lists' WHEN kept AND goes_on THEN 'goes_on' WHEN asks THEN 'new' WHEN kept AND NOT listed THEN 'asks' ELSE '' END AS role FROM (
      SELECT *, open AND NOT other AND NOT (crossed AND NOT lists AND NOT goes_on) AS kept FROM (
        SELECT t.*, g.open, g.number, g.question, g.gpage, g.gcol, g.listed, g.lpage, g.lcol, g.ly, g.lx, g.lmark, {_OTHER} AS other, {_CROSS} AS crossed, (t.option OR {_LISTS}) AS lists, {_GOES_ON} AS goes_on
        FROM fold g JOIN read t ON t.doc_id = g.doc_id AND t.k = g.k + 1
      )
    )
  )
), members AS (SELECT *, CASE WHEN role = 'new' THEN 'asks' ELSE role END AS what FROM fold WHERE role <> ''),
counted AS (SELECT *, count(*) FILTER (what = 'lists') OVER (PARTITION BY doc_id, number ORDER BY k) AS nth FROM members),
parts AS (
  SELECT doc_id, number, nth, min(k) AS k, arg_min(pos, k) AS pos,
    string_agg(CASE WHEN what = 'lists' AND starts_with(text, '[ ]') THEN text[5:] WHEN what = 'lists' AND (starts_with(text, 'X ') OR starts_with(text, '☐ ')) THEN text[3:] ELSE text END, ' ' ORDER BY k) AS said, arg_min(text, k) AS head
  FROM counted GROUP BY doc_id, number, nth
), options AS (
  SELECT doc_id, number, string_agg(said || CASE WHEN starts_with(head, 'X ') THEN '|true|X' WHEN starts_with(head, '☐ ') THEN '|false|☐' WHEN starts_with(head, '[ ]') THEN '|false| ' ELSE '|false|' END, '; ' ORDER BY nth) AS options, count(*) FILTER (starts_with(head, 'X ')) AS chosen
  FROM parts WHERE nth > 0 GROUP BY doc_id, number
)"""

#: lines of all tables, the first table of each document that has a column of texts and one of codes, and the rows that its tables give (``once``)
CODES = """
lines AS (
  SELECT o_custkey AS doc_id, o_orderkey AS sheet, o_orderpriority AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row,
    CASE WHEN l_returnflag = 'R' THEN 'returned parts:' WHEN l_linenumber = 3 THEN ' ' ELSE 'part ' || l_linestatus END AS text, CAST(l_partkey % 500 AS VARCHAR) AS code
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), paired AS (
  SELECT o_custkey AS doc_id, o_orderkey AS sheet, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Name of part' ELSE 'part of sale ' || o_orderkey END AS text_header,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Code of part' ELSE lpad(CAST(o_orderkey % 9000 AS VARCHAR), 4, '7') END AS code_header
  FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT sheet FROM lines WHERE row <= 5 AND trim(text) <> '')
), anchors AS (SELECT * FROM paired QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sheet) = 1),
given AS (
  SELECT doc_id, sheet, row, text, code FROM lines WHERE trim(text) <> ''
  UNION ALL
  SELECT o_custkey, o_orderkey, -1, 'part of sale ' || o_orderkey, lpad(CAST(o_orderkey % 9000 AS VARCHAR), 4, '7') FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey NOT IN (SELECT sheet FROM anchors)
), used AS (SELECT g.*, a.text_header, a.code_header FROM given g JOIN anchors a USING (doc_id) WHERE g.doc_id IN (SELECT doc_id FROM given GROUP BY doc_id HAVING count(DISTINCT sheet) >= 2)),
once AS (SELECT * FROM used QUALIFY row_number() OVER (PARTITION BY doc_id, text, code ORDER BY sheet, row) = 1)"""

SQL = {
    "j19_marked_lines": f"WITH RECURSIVE {LINES}, {MARKED} SELECT * FROM marked",
    "l11_unwrapped_lines": f"WITH RECURSIVE {LINES}, {unwrapped('lines')} SELECT doc_id, pos, text, page, column_id, y, x FROM unwrapped",
    "l31_scoped_groups": f"""
WITH RECURSIVE {LINES}, {MARKED}, {unwrapped('marked')}, {GROUPS}
SELECT o.doc_id, (SELECT arg_min(p.pos, p.k) FROM parts p WHERE p.doc_id = o.doc_id AND p.number = o.number) AS pos, 'group' AS group_id, coalesce(q.said, 'Unknown question') AS question,
  CASE WHEN contains(lower(coalesce(q.said, '')), 'following statements') OR chosen > 1 THEN 'multi_choice' ELSE 'single_choice' END AS group_type, options
FROM options o LEFT JOIN parts q ON q.doc_id = o.doc_id AND q.number = o.number AND q.nth = 0
""",
    "u5_continued_tables": f"""
WITH {CODES}
SELECT doc_id, sheet, row, text_header, code_header, text, code FROM once WHERE NOT suffix(trim(text), ':')
""",
    "p7_without_headings": f"""
WITH {CODES}
SELECT doc_id, sheet, count(*) AS rows, CAST(sum(row) AS BIGINT) AS places FROM lines
WHERE NOT (suffix(text, ':') AND sheet IN (SELECT sheet FROM paired))
GROUP BY 1, 2
""",
    "j18_cells_under_headers": """
WITH e AS (SELECT user_id AS table_id, event_id AS pos, event_type, value + CAST(event_id % 7 AS DOUBLE) / 2 AS middle FROM events),
near AS (
  SELECT c.table_id, c.pos // 300 AS row, c.pos, c.event_type AS text, h.pos AS header FROM e c JOIN e h ON h.table_id = c.table_id AND h.event_type = 'click' AND c.event_type <> 'click' AND c.pos % 13 <> 0
  QUALIFY row_number() OVER (PARTITION BY c.table_id, c.pos ORDER BY abs(h.middle - c.middle), h.pos) = 1
)
SELECT CAST(table_id AS BIGINT) AS table_id, CAST(row AS BIGINT) AS row, CAST(header AS BIGINT) AS header, string_agg(text, ' ' ORDER BY pos) AS text FROM near GROUP BY ALL
""",
    "l2_page_columns": """
WITH RECURSIVE lines AS (SELECT CAST(user_id AS BIGINT) AS page_id, CAST(event_id AS BIGINT) AS id, CASE WHEN event_type <> 'error' THEN round(value, 2) * 8 END AS x0 FROM events),
edges AS (
  SELECT page_id, min(x0) AS edge, 1 AS nth FROM lines WHERE x0 IS NOT NULL GROUP BY page_id
  UNION ALL
  SELECT e.page_id, (SELECT min(x0) FROM lines l WHERE l.page_id = e.page_id AND l.x0 - e.edge > 120) AS next, nth + 1 FROM edges e WHERE next IS NOT NULL
)
SELECT l.page_id, l.id, l.x0, CASE WHEN l.x0 IS NOT NULL THEN (SELECT arg_min(nth, (abs(edge - l.x0), nth)) FROM edges e WHERE e.page_id = l.page_id AND edge IS NOT NULL) END AS column_id FROM lines l
""",
    "l33_sections": f"""
WITH RECURSIVE {GROUPS_OF_TABLES}, sections AS (
  SELECT o_custkey AS doc_id, o_orderkey AS n, CASE WHEN o_orderstatus = 'F' THEN 'Sale' ELSE 'Section ' || o_orderkey END AS title,
    CASE WHEN o_orderstatus = 'P' THEN 'nothing' ELSE 'note is sale ' || o_orderkey || ' delivered to the client see note which of the parts apply to the sale' END AS text FROM orders WHERE o_orderpriority <> '1-URGENT'
), asked AS (SELECT doc_id, t * 1000000 + g AS pos, 'group_' || t || '_' || g AS group_id, lower(replace(question, '?', '')) AS said FROM every)
SELECT s.doc_id, 'section_' || n AS section_id, title, coalesce(string_agg(group_id, ',' ORDER BY pos) FILTER (group_id IS NOT NULL), '') AS group_ids
FROM sections s LEFT JOIN asked a ON a.doc_id = s.doc_id AND contains(s.text, a.said) GROUP BY s.doc_id, n, title
UNION ALL
SELECT doc_id, 'section_form_root', 'Form Body', string_agg(group_id, ',' ORDER BY pos) FROM asked WHERE doc_id NOT IN (SELECT doc_id FROM sections) GROUP BY doc_id
""",
}


def _folded(order: str, near: str, after: str, values: str, name: str) -> str:
    """Pieces of a page in ``order``: each joins the first of the lines so far that it is near to (v: a line's values), which then is ``after``."""
    return f"""
WITH RECURSIVE pieces AS (SELECT {{page}} AS page, event_id AS id, {values}, row_number() OVER (PARTITION BY {{page}} ORDER BY {order}) AS nth FROM events),
fold AS (
  SELECT page, id, nth, 0 AS k, [[y, 1.0::DOUBLE]] AS lines FROM pieces WHERE nth = 1
  UNION ALL
  SELECT page, id, nth, coalesce(joined, len(lines) + 1) - 1, CASE WHEN joined IS NULL THEN list_append(lines, [y, 1.0::DOUBLE]) ELSE list_transform(lines, lambda v, i: CASE WHEN i = joined THEN {after} ELSE v END) END
  FROM (SELECT p.*, f.lines, list_position(list_transform(f.lines, lambda v: {near}), true) AS joined FROM fold f JOIN pieces p ON p.page = f.page AND p.nth = f.nth + 1)
)
SELECT page, CAST(id AS BIGINT) AS id, CAST(k AS INT) AS {name} FROM fold
"""


_PAGE = "CAST(user_id * 10000 + date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', ts) AS DATE)) // 7 AS BIGINT)"
SQL["w9_row_bands"] = _folded("CAST(event_id % 700 AS DOUBLE), value, event_id", "abs(p.y - v[1]) <= 11", "[(v[1] * v[2] + y) / (v[2] + 1), v[2] + 1]", "CAST(event_id % 700 AS DOUBLE) AS y", "band").replace("{page}", _PAGE)
SQL["l1_word_lines"] = _folded("CAST(event_id % 300 AS DOUBLE), value, event_id", "abs(p.y - v[1]) <= 4", "[least(v[1], y), v[2] + 1]", "CAST(event_id % 300 AS DOUBLE) AS y", "line").replace("{page}", _PAGE)
