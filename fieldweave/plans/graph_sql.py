"""DuckDB SQL of the synonym graph's context: all names with all, from the definitions."""

from __future__ import annotations

from fieldweave.plans.sql_parts import LABELS, LOG, NAMED

_ONE = {"id": "identity.identifier", "revenue": "finance.revenue"}
_REST = {
    "quantity": "inventory.quantity", "organization": "entity.organization", "customer": "entity.customer", "product": "entity.product", "name": "identity.name", "description": "text.description",
    "creator": "ownership.creator", "responsible": "ownership.responsible", "source": "channel.source", "partner": "entity.partner",
}
_when = lambda rules: " ".join(f"WHEN list_contains(canonical, '{w}') THEN '{c}'" for w, c in rules.items())
CONCEPT = f"""CASE WHEN list_has_all(canonical, ['created', 'date']) THEN 'temporal.creation' WHEN list_has_all(canonical, ['updated', 'date']) THEN 'temporal.update' {_when(_ONE)}
  WHEN list_has_all(canonical, ['amount', 'gross']) THEN 'finance.amount.gross' WHEN list_has_all(canonical, ['amount', 'net']) THEN 'finance.amount.net' WHEN list_contains(canonical, 'amount') THEN 'finance.amount' {_when(_REST)} END"""


def _same(a: str, b: str, weights: dict[str, float], concept: float) -> str:
    parts = " + ".join(f"CASE WHEN {a}.{c} = {b}.{c} THEN {w} ELSE 0 END" for c, w in weights.items())
    return f"round(least(1.0, greatest({parts}, CASE WHEN {a}.concept = {b}.concept THEN {concept} ELSE 0 END)), 6)"


NODES = f"""
{LOG}, {LABELS}, {NAMED}, nodes AS (SELECT label, array_to_string(toks, '') AS node, attribute, entity, role, {CONCEPT} AS concept FROM named),
close AS (
  SELECT DISTINCT t.node AS target, n.node AS anchor, {_same('t', 'n', {'attribute': 0.5, 'role': 0.3, 'entity': 0.2}, 0.62)} AS alike
  FROM nodes t JOIN nodes n ON n.node <> t.node AND (n.attribute = t.attribute OR n.role = t.role OR n.entity = t.entity) WHERE t.label IN (SELECT target FROM log)
), anchors AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY alike DESC, anchor) AS rank FROM close WHERE alike > 0)"""

SQL = {
    "t5_top_anchors": f"WITH {NODES} SELECT target, anchor, CAST(alike AS DOUBLE) AS alike, CAST(rank AS INT) AS rank FROM anchors WHERE rank <= 3",
    "m27_graph_candidates": f"""
WITH {NODES}, edges AS (
  SELECT user_id AS owner, least(s.node, t.node) AS l, greatest(s.node, t.node) AS r, count(*) FILTER (accepted) AS accepts, count(*) FILTER (NOT accepted) AS rejects, avg(confidence) AS confidence
  FROM log JOIN nodes s ON s.label = source JOIN nodes t ON t.label = target WHERE s.node <> t.node GROUP BY ALL
), ends AS (SELECT l, r FROM edges UNION SELECT r, l FROM edges),
sides AS (SELECT owner, l AS node, r AS other, true AS at_left, 0.7 * accepts / greatest(1, accepts + rejects) + 0.3 * confidence AS b FROM edges UNION ALL SELECT owner, r, l, false, 0.7 * accepts / greatest(1, accepts + rejects) + 0.3 * confidence FROM edges),
asked AS (SELECT * FROM (SELECT DISTINCT user_id, source FROM log) JOIN (SELECT DISTINCT user_id, target FROM log) USING (user_id)),
pairs AS (SELECT a.*, s.node AS sn, t.node AS tn, s.attribute AS sa, s.entity AS se, s.role AS sr, s.concept AS sc, t.attribute AS ta, t.entity AS te, t.role AS tr FROM asked a JOIN nodes s ON s.label = a.source JOIN nodes t ON t.label = a.target),
found AS (
  SELECT p.user_id, p.source, p.target, 3 AS rank, 'direct' AS path, least(1.0, b + CASE WHEN owner = p.user_id THEN 0.08 ELSE 0 END) AS s FROM pairs p JOIN sides e ON e.node = p.tn AND e.other = p.sn
  UNION ALL
  SELECT p.user_id, p.source, p.target, 2, 'transitive', least(1.0, 0.72 * (b + CASE WHEN owner = p.user_id THEN 0.08 ELSE 0 END))
  FROM pairs p JOIN sides e ON e.node = p.sn AND p.sn <> p.tn JOIN ends n ON n.l = p.tn AND n.r = e.other
  WHERE NOT (e.at_left AND EXISTS (SELECT 1 FROM ends x WHERE x.l = p.tn AND x.r = p.sn))
  UNION ALL
  SELECT p.user_id, p.source, p.target, 1, 'concept_cluster', least(1.0, 0.66 * (b + CASE WHEN owner = p.user_id THEN 0.08 ELSE 0 END)) * a.alike * beside
  FROM (
    SELECT p.*, a.anchor, a.alike, e.owner, e.b, round(least(1.0, greatest(CASE WHEN p.sa = c.attribute THEN 0.45 ELSE 0 END + CASE WHEN p.sr = c.role THEN 0.25 ELSE 0 END + CASE WHEN p.se = c.entity THEN 0.2 ELSE 0 END, CASE WHEN p.sc = c.concept THEN 0.58 ELSE 0 END)), 6) AS beside
    FROM pairs p JOIN anchors a ON a.target = p.tn AND a.rank <= 10 JOIN sides e ON e.node = a.anchor AND e.other <> p.tn JOIN (SELECT DISTINCT node, attribute, entity, role, concept FROM nodes) c ON c.node = e.other
    WHERE e.at_left OR NOT EXISTS (SELECT 1 FROM anchors z WHERE z.target = p.tn AND z.rank <= 10 AND z.anchor = e.other)
  ) p, (SELECT 1) WHERE beside > 0
), best AS (SELECT user_id, source, target, path, round(s, 6) AS s FROM found QUALIFY row_number() OVER (PARTITION BY user_id, source, target ORDER BY round(s, 6) DESC, rank DESC) = 1),
scored AS (
  SELECT p.user_id AS case_id, p.source, p.target, path, round(coalesce(s, 0), 4) AS graph_score, s,
    CAST(CASE WHEN sa = ta THEN CASE WHEN se = te THEN 0.28 WHEN se IS NULL OR te IS NULL THEN 0.12 ELSE -0.18 END WHEN sr = tr THEN CASE WHEN se = te THEN 0.16 WHEN se IS NULL OR te IS NULL THEN 0.08 ELSE -0.14 END ELSE 0 END AS DOUBLE) AS context_score
  FROM pairs p LEFT JOIN best USING (user_id, source, target)
)
SELECT case_id, source, target, coalesce(path, 'context') AS path, round(greatest(0.0, least(1.0, coalesce(s, 0) + context_score)), 4) AS score, CAST(graph_score AS DOUBLE) AS graph_score, context_score
FROM scored WHERE round(greatest(0.0, least(1.0, coalesce(s, 0) + context_score)), 4) > 0 AND (s IS NOT NULL OR context_score > 0)
""".replace("* a.alike * beside", "* alike * beside").replace(") p, (SELECT 1) WHERE", ") p WHERE"),
}
