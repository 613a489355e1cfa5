"""DuckDB SQL of text read off images, walked piece by piece."""

from __future__ import annotations

from fieldweave.operators.read_lines import CYRILLIC, LATIN, MARKS, WINDOW_WORDS
from fieldweave.plans.sql_parts import _list

_MARKS = _list(MARKS)
PIECES = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
pieces AS (
  SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id AS BIGINT) AS pos, n // 30 AS page, CAST(CASE WHEN event_type <> 'signup' THEN floor(value) * 3 END AS DOUBLE) AS x,
    CAST((n % 30) // 5 * 11 + event_id % 3 AS DOUBLE) AS y, CAST(event_id % 40 + 5 AS DOUBLE) AS width, 9.0::DOUBLE AS height,
    ['X', 'Sum', '2O25-1-3', 'Cуммa', '12O,5S', '--', 'Search it', 'TOTAL AMOUNT', 'aaaa', 'l.O2.2025', 'plain words', '№', 'ok', 'http://x', '7', '2025/02/31'][(event_id * 5 + CAST(floor(value) AS BIGINT)) % 16 + 1] AS text,
    round(least(value / 60, 1.0), 4) AS confidence, CASE WHEN event_type = 'click' THEN 0.9 ELSE 1.0 END::DOUBLE AS weight,
    row_number() OVER (PARTITION BY user_id ORDER BY n // 30, (n % 30) // 5 * 11 + event_id % 3, coalesce(CASE WHEN event_type <> 'signup' THEN floor(value) * 3 END, 0), event_id) AS k
  FROM numbered
)"""

JOINED = f"""
{PIECES}, walk AS (
  SELECT doc_id, k, 1 AS run, page, y, x, width, text FROM pieces WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN goes_on THEN run ELSE run + 1 END, page, CASE WHEN goes_on THEN least(hy, y) ELSE y END, CASE WHEN goes_on THEN least(hx, x) ELSE x END,
    CASE WHEN goes_on THEN greatest(hx + hwidth, x + width) - least(hx, x) ELSE width END, CASE WHEN goes_on THEN htext || ' ' || text ELSE text END
  FROM (
    SELECT p.*, w.run, w.y AS hy, w.x AS hx, w.width AS hwidth, w.text AS htext,
      coalesce(w.page = p.page AND abs(w.y - p.y) <= 14 AND p.x - (w.x + w.width) BETWEEN -4 AND 48 AND (w.text IN ({_MARKS}) OR p.text IN ({_MARKS}) OR length(w.text) <= 3 OR length(p.text) <= 3 OR p.x - (w.x + w.width) <= 24), false) AS goes_on
    FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.k = w.k + 1
  )
), joined AS (
  SELECT p.doc_id, any_value(p.page) AS page, arg_min(p.pos, p.k) AS pos, min(p.x) AS x, min(p.y) AS y, max(p.x + p.width) - min(p.x) AS width, max(p.y + p.height) - min(p.y) AS height, string_agg(p.text, ' ' ORDER BY p.k) AS text, max(p.confidence) AS confidence, arg_min(p.weight, p.k) AS weight
  FROM pieces p JOIN walk w USING (doc_id, k) GROUP BY p.doc_id, w.run
)"""

_HINTS = " OR ".join(f"contains(lower(text), '{w}')" for w in WINDOW_WORDS)
_DIGITS = "translate(%s, 'оОoOIl|Ss', '000011155')"
_DATE = f"translate({_DIGITS % 'text'}, './', '--')"
_ONE = f"CASE WHEN len(regexp_extract_all(text, '[А-яЁё]')) = 0 OR len(regexp_extract_all(text, '[A-Za-z]')) = 0 THEN text WHEN len(regexp_extract_all(text, '[А-яЁё]')) >= len(regexp_extract_all(text, '[A-Za-z]')) THEN translate(text, '{LATIN}', '{CYRILLIC}') ELSE translate(text, '{CYRILLIC}', '{LATIN}') END"

SQL = {
    "l19_joined_pieces": f"WITH RECURSIVE {JOINED} SELECT * FROM joined",
    "l20_best_readings": rf"""
WITH RECURSIVE {JOINED}, shots AS (SELECT CAST(user_id AS BIGINT) AS doc_id, min(event_id) % 2 = 0 AS shot FROM events GROUP BY user_id),
told AS (SELECT *, lower(text) AS key, count(*) OVER (PARTITION BY doc_id, lower(text)) AS repeats, len(string_split(text, ' ')) AS words, length(text) AS n FROM joined JOIN shots USING (doc_id)),
kept AS (
  SELECT * FROM told
  WHERE (text IN ({_MARKS}) OR (confidence >= 0.42 AND regexp_matches(text, '[\p{{L}}\p{{N}}]') AND NOT ((n <= 2 OR (words <= 2 AND n <= 8)) AND confidence < 0.6) AND NOT (n >= 3 AND len(list_distinct(string_split(text, ''))) = 1)))
    AND NOT regexp_matches(lower(text), 'http://|https://|www\.')
    AND NOT (shot AND ({_HINTS} OR (repeats > 1 AND words <= 3 AND n <= 24) OR (y + height >= 70 * 0.94 AND words <= 5)
      OR (y <= 70 * 0.12 AND ((words <= 6 AND (contains(text, '.') OR contains(text, ':') OR n <= 24)) OR len(regexp_extract_all(text, '\p{{Lu}}')) >= greatest(4, n // 2)))))
)
SELECT doc_id, pos, text, x, y FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY confidence * weight DESC, page, y, coalesce(x, 0), pos) = 1
""",
    "l21_page_rows": rf"""
WITH RECURSIVE {PIECES}, walk AS (
  SELECT doc_id, k, 1 AS run, page, y FROM pieces WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN w.page = p.page AND abs(w.y - p.y) <= 12 THEN w.run ELSE w.run + 1 END, p.page, CASE WHEN w.page = p.page AND abs(w.y - p.y) <= 12 THEN w.y ELSE p.y END FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.k = w.k + 1
), tokens AS (
  SELECT p.*, w.run, CASE WHEN text IN ({_MARKS}) THEN text WHEN regexp_matches(text, '[-./]') AND regexp_matches({_DATE}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') AND TRY_CAST(string_split({_DATE}, '-')[2] AS INT) BETWEEN 1 AND 12 AND TRY_CAST(string_split({_DATE}, '-')[3] AS INT) BETWEEN 1 AND 31
      THEN string_split({_DATE}, '-')[1] || '-' || lpad(string_split({_DATE}, '-')[2], 2, '0') || '-' || lpad(string_split({_DATE}, '-')[3], 2, '0')
    WHEN regexp_matches({_ONE}, '^[0-9OoОоIlI|lSBs$.,:/-]+$') THEN {_DIGITS % _ONE} ELSE {_ONE} END AS token
  FROM pieces p JOIN walk w USING (doc_id, k)
), clean AS (
  SELECT *, NOT (token IN ({_MARKS})) AND (NOT regexp_matches(token, '[\p{{L}}\p{{N}}]') OR length(token) < 2 OR (length(token) <= 2 AND NOT regexp_matches(token, '^\d+$'))) AS noise FROM tokens
), placed AS (
  SELECT *, x - last_value(x + width IGNORE NULLS) OVER (PARTITION BY doc_id, run, noise ORDER BY coalesce(x, 0), y, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 56 AS parted FROM clean
)
SELECT doc_id, run AS row, CASE WHEN any_value(page) = 0 THEN 1 ELSE any_value(page) END AS page, string_agg(CASE WHEN coalesce(parted, false) THEN '| ' ELSE '' END || token, ' ' ORDER BY coalesce(x, 0), y, pos) FILTER (NOT noise) AS text, max(confidence) AS confidence
FROM placed GROUP BY doc_id, run HAVING text IS NOT NULL
""",
}
