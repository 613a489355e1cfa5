"""Groups of lines on pages against the rules told line by line, and by example."""

import random
import re

import pytest

from fieldweave.operators import form_lines as L
from fieldweave.plans.form_queries import PAGE_LINES

LINE = "doc_id long, pos long, text string, page long, column_id long, y double, x double"
MARKS = r"^\s*([XxVv✓✔☒☑□☐○◯Iil|/\\Oo])\s*(.+)$"
BOXES = r"^\s*\[([XxVv✓✔Iil|/\\Oo ])\]\s*(.+)$"
ASKS = "Является ли выгодоприобретатель налоговым резидентом только в РФ"


def words(t):
    return re.findall("[a-zа-я0-9]+", t.lower())


def option(t):
    m = re.match(MARKS, t) or re.match(BOXES, t)
    return (m[2].strip(), m[1] in "xXvV✓✔☒☑■Il|/\\", m[1]) if m else None


def starts(t):
    w = words(t)
    return bool(w) and not (len(w) > 1 and w[1] == "ли") and not t.endswith("?") and (w[0] in ("да", "нет", "yes", "no", "не") or "%" in t or any(c.isdigit() for c in t))


def asks(t):
    return not starts(t) and (("?" in t and len(words(t)) >= 3) or (len(words(t)) >= 5 and len(t) >= 24))


def pair(t):
    m = re.match(r"^([^:]{2,120}?)\s*:\s*(.+)$", t)
    return bool(m) and len(m[1]) <= 80 and len(words(m[1])) <= 8


def many(q):
    return "following statements" in " ".join(words(q)) or "хотя бы одно" in " ".join(words(q))


def differ(a, b):
    return a is not None and b is not None and a != b


def unmarked(t, g, line):
    w, last = words(t), g["options"][-1] if g["options"] else None
    if pair(t) or not 2 <= len(w) <= 18 or differ(line["page"], g["page"]):
        return False
    own = last["column_id"] if last else None
    if differ(own, line["column_id"]):
        return False
    if differ(line["column_id"], g["column_id"]):
        return True
    if own is None and g["column_id"] is not None and line["column_id"] == g["column_id"]:
        return starts(t)
    if asks(t):
        return False
    return many(g["question"]) or w[0] in ("да", "нет", "yes", "no") or "%" in t or any(c.isdigit() for c in t) or bool(g["options"])


def goes_on(t, g, line):
    if not g["options"]:
        return False
    last = g["options"][-1]
    near = not asks(t) and not pair(t) and all(last[c] is None or line[c] in (None, last[c]) for c in ("page", "column_id"))
    near = near and all(last[c] is None or line[c] is None or abs(line[c] - last[c]) <= d for c, d in (("y", 14), ("x", 96)))
    if near:
        return not last["marker"].strip() and not last["selected"] and not starts(t)
    return many(g["question"]) and not starts(t) and len(words(t)) <= 8 and (t[:1].isupper() or t[:1] in "(/-")


def brute(lines):
    """Groups of one document's lines: (first pos, question, [(label, selected, marker)])."""
    out, g = [], None
    for line in sorted(lines, key=lambda r: (r["page"] or 0, r["column_id"] or 0, r["y"] or 0, r["x"] or 0, r["pos"])):
        t = " ".join((line["text"] or "").split())
        if not t:
            continue
        o = option(t) or ((t, False, "") if g and unmarked(t, g, line) else None)
        if g and (differ(g["page"], line["page"]) or (differ(g["column_id"], line["column_id"]) and not o and not goes_on(t, g, line))):
            g = None
        if o:
            if g is None:
                g = {**line, "question": L.UNKNOWN, "options": []}
                out.append(g)
            g["options"].append({**line, "label": o[0], "selected": o[1], "marker": o[2]})
        elif g and g["options"] and goes_on(t, g, line):
            g["options"][-1]["label"] += " " + t
        elif asks(t):
            g = {**line, "question": t, "options": []}
            out.append(g)
        elif g and not g["options"]:
            g["question"] += " " + t
    return [(g["pos"], g["question"], [(o["label"], o["selected"], o["marker"]) for o in g["options"]]) for g in out if g["options"]]


def frame(spark, lines):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "pos", "text", "page", "column_id", "y", "x")) for r in lines], LINE)


def of(groups):
    return sorted((r.doc_id, r.pos, r.question, [(o.label, o.selected, o.marker) for o in r.options]) for r in groups.collect())


def test_groups_equal_the_rules(spark):
    rnd = random.Random(7)
    texts = [*PAGE_LINES, "Нет", "10% of it", "Является ли хотя бы одно верным", "a: b", "one", "CAPITALS In Four Words"]
    docs = {d: [{"doc_id": d, "pos": k, "text": rnd.choice(texts), "page": rnd.choice([None, 1, 1, 2]), "column_id": rnd.choice([None, 1, 1, 2]), "y": rnd.choice([None, 4.0 * k]), "x": rnd.choice([None, 0.0, 50.0, 150.0])} for k in range(rnd.randrange(1, 40))] for d in range(60)}
    want = sorted((d, *g) for d, lines in docs.items() for g in brute(lines))
    assert of(L.line_groups(frame(spark, [r for lines in docs.values() for r in lines]).repartition(5))) == want and len(want) > 60


def made(rows):
    return [{"doc_id": 1, "pos": k, "text": t, "page": p, "column_id": c, "y": float(y), "x": float(x)} for k, (t, p, c, y, x) in enumerate(rows)]


def test_columns_and_wrapped_options(spark):
    lines = made([(ASKS, 1, 1, 10, 20), ("X", 1, 1, 28, 20), ("Не являюсь налоговым резидентом", 1, 1, 28, 44), ("в иностранном государстве", 1, 1, 40, 56), ("Контактное лицо", 1, 2, 28, 470)])
    got = L.line_groups(L.unwrapped(L.with_marks(frame(spark, lines)))).collect()
    assert [(r.group_id, len(r.options), r.options[0].label) for r in got] == [("tax_residency", 1, "Не являюсь налоговым резидентом в иностранном государстве")]


def test_a_mark_takes_the_nearest_text_that_is_left(spark):
    lines = made([("X", 1, None, 10, 20), ("☐", 1, None, 11, 20), ("near", 1, 3, 12, 30), ("farther", 1, None, 13, 60), ("left of it", 1, None, 13, 5), ("X", 1, None, 40, 20), ("too low", 1, None, 47, 30), ("X", 2, None, 10, 20), ("too far right", 2, None, 10, 300)])
    got = {(r.text, r.x, r.column_id) for r in L.with_marks(frame(spark, lines)).collect()}
    assert got == {("X near", 20.0, 3), ("☐ farther", 20.0, None), ("left of it", 5.0, None), ("X", 20.0, None), ("too low", 30.0, None), ("too far right", 300.0, None)}


def test_greedy_marks_equal_brute_force(spark):
    rnd = random.Random(3)
    lines = [{"doc_id": d, "pos": k, "text": rnd.choice(["X", "☐", "a", "b", ""]), "page": rnd.choice([1, 2]), "column_id": None, "y": float(rnd.randrange(30)), "x": float(rnd.randrange(0, 400, 20))} for d in range(20) for k in range(40)]
    want = set()
    for d in range(20):
        used = set()
        rows = sorted((r for r in lines if r["doc_id"] == d), key=lambda r: (r["page"], r["y"], r["x"], r["pos"]))
        for i, m in enumerate(rows):
            if m["text"] in ("X", "☐"):
                near = [(abs(t["y"] - m["y"]) + (t["x"] - m["x"]) / 100, j) for j, t in enumerate(rows) if j > i and j not in used and t["page"] == m["page"] and t["text"] in ("a", "b") and abs(t["y"] - m["y"]) <= 6 and 0 <= t["x"] - m["x"] <= 256]
                if near:
                    used.add(min(near)[1])
                    want.add((d, m["pos"], rows[min(near)[1]]["pos"]))
    assert {(r.doc_id, r.mark, r.text) for r in L.nearest_texts(frame(spark, lines)).collect()} == want and len(want) > 50


@pytest.mark.parametrize("rows", [[], [(None, None, None, 0, 0)], [("", 1, 1, 0, 0), ("X", 1, 1, 0, 0)]])
def test_lines_of_nothing(spark, rows):
    assert L.line_groups(L.unwrapped(L.with_marks(frame(spark, made(rows))))).collect() == []
