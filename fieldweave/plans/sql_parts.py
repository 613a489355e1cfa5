"""Parts of the queries in DuckDB's SQL: names, the log, texts, gates."""

from __future__ import annotations

from fieldweave.functions import lexicon as L


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def tokens(x: str) -> str:
    """Name tokens: no look-around in this engine, so digits take two passes."""
    out = rf"regexp_replace(coalesce({x}, ''), '([a-zа-я0-9])([A-ZА-Я])', '\1 \2', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '([A-Za-zА-Яа-я])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-zА-Яа-я])', '\1 \2', 'g')"
    out = f"list_filter(regexp_split_to_array(lower(trim({out})), '[^a-zA-Zа-яА-Я0-9]+'), lambda w: w <> '' AND w NOT IN ({_list(L.STOPWORDS)}))"
    word = "w"
    for letter, latin in L.CYRILLIC_MANY.items():
        word = f"replace({word}, '{letter}', '{latin}')"
    return f"list_transform({out}, lambda w: translate({word}, '{L.CYRILLIC_ONE[0] + L.CYRILLIC_NONE}', '{L.CYRILLIC_ONE[1]}'))"


def meanings(x: str) -> str:
    return f"list_transform({x}, lambda w: coalesce({_map(L.CANONICAL)}[w], w))"


#: name, tokens, canonical, attribute, entity, role of all labels of a relation ``labels``
NAMED = f"""
named AS (
  SELECT *, {_map(L.ROLES)}[attribute] AS role,
    coalesce(list_filter(canonical, lambda w: w <> attribute AND w NOT IN ({_list(L.ENTITY_STOPWORDS)}, 'with', 'without'))[1], list_filter(canonical, lambda w: w <> attribute)[1]) AS entity
  FROM (SELECT *, coalesce(list_filter(list_reverse(canonical), lambda w: w IN ({_list(L.ROLES)}))[1], canonical[-1]) AS attribute
        FROM (SELECT *, {meanings('toks')} AS canonical FROM (SELECT label, {tokens('label')} AS toks FROM labels)))
)"""

LOG = """
log AS (
  SELECT event_id, ts, user_id,
    CASE event_type WHEN 'click' THEN 'created date' WHEN 'view' THEN 'total amount' WHEN 'signup' THEN 'customer name' WHEN 'purchase' THEN 'revenue amount' WHEN 'error' THEN 'email' END AS source,
    ['creationDate', 'updateDate', 'amount', 'name', 'revenue', 'id', 'email'][CAST(json_extract_string(props, '$.k') AS INT) % 7 + 1] AS target,
    NOT (event_type = 'purchase' AND value < 40) AS accepted,
    greatest(0.6, least(value / 100, 1.0)) AS confidence
  FROM events
)"""

LABELS = "labels AS (SELECT DISTINCT source AS label FROM log UNION SELECT DISTINCT target FROM log)"


def _conflict(pairs, left: str, right: str, strict: bool) -> str:
    parts = []
    for a, b, p in pairs:
        has = lambda x, w: f"list_contains({x}, '{w}')"
        if strict:
            one = f"({has(left, a)} AND NOT {has(left, b)} AND {has(right, b)} AND NOT {has(right, a)})"
            two = f"({has(left, b)} AND NOT {has(left, a)} AND {has(right, a)} AND NOT {has(right, b)})"
        else:
            one, two = f"({has(left, a)} AND {has(right, b)})", f"({has(left, b)} AND {has(right, a)})"
        parts.append(f"CASE WHEN {one} OR {two} THEN {p} ELSE 0.0 END")
    return f"greatest({', '.join(parts)})"


def _has(*words: str) -> str:
    return " AND ".join(f"list_contains(both_c, '{w}')" for w in words)


STATS = f"""
{LOG}, {LABELS}, {NAMED},
agg AS (
  SELECT source, target, count(*) AS support, count(DISTINCT user_id) AS users, count(*) FILTER (accepted) AS accepts, count(*) FILTER (NOT accepted) AS rejects, avg(confidence) AS mean_confidence
  FROM log GROUP BY source, target
), joined AS (
  SELECT a.*, s.toks AS s_toks, s.canonical AS sc, t.canonical AS tc, list_concat(t.canonical, s.canonical) AS both_c, s.role AS s_role, t.role AS t_role
  FROM agg a JOIN named s ON s.label = a.source JOIN named t ON t.label = a.target
), features AS (
  SELECT *, accepts / (accepts + rejects) AS acceptance, 1 - accepts / (accepts + rejects) AS drift,
    CAST({_conflict(L.PATTERN_CONFLICTS, 'sc', 'tc', True)} AS DOUBLE) AS conflict,
    CASE WHEN {_has('created', 'date')} THEN 'created_at' WHEN {_has('updated', 'date')} THEN 'updated_at' WHEN {_has('id')} THEN 'identifier' WHEN {_has('revenue')} THEN 'revenue'
         WHEN {_has('amount')} THEN 'amount' WHEN {_has('quantity')} THEN 'quantity' WHEN {_has('name')} THEN 'label' WHEN {_has('description')} THEN 'description'
         WHEN {_has('boolean')} THEN 'flag' ELSE coalesce(t_role, s_role) END AS role,
    CASE WHEN {_has('created', 'date')} THEN 'temporal.creation' WHEN {_has('updated', 'date')} THEN 'temporal.update' WHEN {_has('id')} THEN 'identity.identifier'
         WHEN {_has('revenue')} THEN 'finance.revenue' WHEN {_has('amount', 'gross')} THEN 'finance.amount.gross' WHEN {_has('amount', 'net')} THEN 'finance.amount.net'
         WHEN {_has('amount')} THEN 'finance.amount' WHEN {_has('quantity')} THEN 'inventory.quantity' WHEN {_has('organization')} THEN 'entity.organization'
         WHEN {_has('customer')} THEN 'entity.customer' WHEN {_has('product')} THEN 'entity.product' WHEN {_has('name')} THEN 'identity.name' WHEN {_has('description')} THEN 'text.description' WHEN {_has('creator')} THEN 'ownership.creator' WHEN {_has('responsible')} THEN 'ownership.responsible' WHEN {_has('source')} THEN 'channel.source' WHEN {_has('partner')} THEN 'entity.partner' END AS concept,
    list_filter(sc, lambda w: w NOT IN ({_list(L.SENSITIVE)}) AND NOT regexp_full_match(w, '[0-9]+')) AS kept
  FROM joined
), stats AS (
  SELECT source, target, support, users, accepts, rejects, mean_confidence, acceptance, drift, conflict, role, concept,
    CAST(least(1.0, round(0.8 * len(list_filter(s_toks, lambda w: w IN ({_list(L.SENSITIVE)}))) + CASE WHEN len(s_toks) = 1 AND length(s_toks[1]) >= 12 THEN 0.25 ELSE 0 END, 4)) AS DOUBLE) AS sensitivity,
    CAST(CASE WHEN len(kept) = 0 THEN 0.0 ELSE least(1.0, round(0.2 + CASE WHEN len(kept) <= 5 THEN 0.2 ELSE 0 END + CASE WHEN concept IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN role IS NOT NULL THEN 0.15 ELSE 0 END
      + 0.08 * least(3, len(list_distinct(list_filter(kept, lambda w: w IN ({_list(L.DOMAIN_TAGS)}))))), 4)) END AS DOUBLE) AS generality
  FROM features
)"""

GATES = """CASE WHEN sensitivity >= 0.6 THEN ['blocked_sensitive', 'sensitive_context'] WHEN generality < 0.5 THEN ['personal_only', 'not_generalizable']
  WHEN accepts < 2 OR support < 2 THEN ['personal_only', 'insufficient_accepts'] WHEN accepts < 3 THEN ['shared_candidate', 'insufficient_accepts']
  WHEN users < 2 THEN ['shared_candidate', 'insufficient_cross_user_support'] WHEN acceptance < 0.8 THEN ['shared_candidate', 'low_acceptance_rate']
  WHEN conflict > 0.15 THEN ['personal_only', 'semantic_instability'] WHEN drift > 0.25 THEN ['shared_candidate', 'high_drift']
  WHEN mean_confidence < 0.55 THEN ['shared_candidate', 'low_mean_confidence'] ELSE ['shared_promoted', 'stable_generalized_pattern'] END"""

EDGES = f"""
{LOG}, {LABELS}, joined_names AS (SELECT label, array_to_string({tokens('label')}, '') AS name FROM labels),
ends AS (SELECT l.*, s.name AS sn, t.name AS tn FROM log l JOIN joined_names s ON s.label = l.source JOIN joined_names t ON t.label = l.target),
edges AS (
  SELECT least(sn, tn) AS l, greatest(sn, tn) AS r, count(*) FILTER (accepted) AS accepts, count(*) FILTER (NOT accepted) AS rejects, avg(confidence) AS mean_confidence,
    CASE WHEN arg_max(accepted, (ts, event_id)) THEN 'synonym' ELSE 'conflict' END AS relation
  FROM ends WHERE sn <> tn GROUP BY 1, 2
), both_ways AS (SELECT l AS node, r AS other, accepts, rejects, mean_confidence FROM edges UNION ALL SELECT r, l, accepts, rejects, mean_confidence FROM edges)"""

ESTIMATE = "CAST(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END AS BIGINT)"
CASES = """cases AS (
  SELECT doc_id, lang, quality AS expected, CASE WHEN len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) < 0.3 THEN 0 ELSE 1 END AS got
  FROM documents JOIN labels USING (doc_id)
)"""
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), ' ', ' ', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
#: sentence ends marked by a character no text has, then split
SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({NORMAL}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: trim(s)), lambda s: s <> '')"
HEADING = r"len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 8 AND (suffix(line, ':') OR (len(regexp_extract_all(line, '\p{L}')) > 0 AND len(regexp_extract_all(line, '\p{Lu}')) / greatest(1, len(regexp_extract_all(line, '\p{L}'))) > 0.75))"
ZONE = r"CASE WHEN contains(line, ':') AND words <= 12 THEN 'form' WHEN len(regexp_extract_all(line, '\p{Lu}')) / greatest(1, len(regexp_extract_all(line, '\p{L}'))) >= 0.9 OR words <= 1 THEN 'noise' ELSE 'text' END"
LINES = r"lines AS (SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE line <> '')"
ORDERS = """cells AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE replace(printf('%.2f', o_totalprice), '.', ',') END AS price, CASE WHEN o_orderpriority LIKE '1%' THEN 'yes' ELSE 'no' END AS urgent FROM orders)"""
