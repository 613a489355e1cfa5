import random
import re

import numpy as np

from fieldweave.llm import passages as P
from fieldweave.llm import queries

SF = "/root/testdata/sf0.01"
RND = random.Random(9)


def prose(n):
    return " ".join(f"w{RND.randrange(10**6)}" for _ in range(n))


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t.lower())


def shared(texts, n=50):
    """Documents that share n words in a row with another, by brute force."""
    seen = {}
    for i, t in texts.items():
        w = words(t)
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i for g, s in seen.items() if len(s) > 1 and len(set(g)) > 3 for i in s}


def test_tuning():
    assert P.tuned(0.75, 0.98, rows=1) == 3 and P.tuned(0.75, 0.98, rows=2) == 5 and P.tuned(0.5, 0.5, rows=1) == 1


def test_paragraphs_do_not_depend_on_the_place():
    passage = prose(120)
    inner = []
    for before in (0, 3, 50):
        raw = (prose(before) + " " + passage).encode()
        p = P.Paragraphs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        inner.append(set(p.contents().tolist()))
        assert np.diff(p.begin).max() <= P.FARTHEST
    assert len(inner[0] & inner[1] & inner[2]) >= 0.8 * len(inner[0])


def test_ends_of_a_stretch():
    own, kept = (np.array([hash(w) & (2**63 - 1) for w in t.split()], np.uint64) for t in (prose(70), prose(100)))
    text = np.concatenate((own, kept[20:90], own[::-1]))
    assert P.laid_against(text, 75, 115, kept) == (70, 140)  # grown
    assert P.laid_against(text, 66, 106, kept) == (70, 140)  # trimmed and grown
    edited = text.copy()
    edited[100] = 5
    assert P.laid_against(edited, 91, 119, kept) == (70, 140)
    assert P.laid_against(text, 0, 40, kept[:3]) == (0, 40) and P.laid_against(text, 0, 40, kept[:0]) == (0, 40)


def test_edited_passages_are_cut_by_words(spark):
    """Of the words of pasted passages whose own similarity is 0.75 or more, how many go; and of clean words, how many."""
    rnd = random.Random(3)
    rows, planted, clean = [], {}, {}
    for k in range(60):
        passage = prose(60 + 20 * (k % 6)).split()
        edited = list(passage)
        for _ in range(max(1, len(passage) // 50)):
            edited[rnd.randrange(len(edited))] = prose(1)
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (passage, edited)]
        assert len(sets[0] & sets[1]) >= 0.75 * len(sets[0] | sets[1]) - 1e-9
        before, after = prose(rnd.randrange(90)), prose(rnd.randrange(90))
        rows += [(2 * k, f"{prose(50)} {' '.join(passage)} {prose(50)}"), (2 * k + 1, f"{before} {' '.join(edited)} {after}")]
        planted[2 * k + 1], clean[2 * k + 1] = edited, (before + " " + after).split()
    got = {r.doc_id: words(r.text) for r in P.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {k: set(v) for k, v in got.items()}
    gone = sum(w not in left[k] for k, v in planted.items() for w in v) / sum(map(len, planted.values()))
    lost = sum(w not in left[k] for k, v in clean.items() for w in v) / sum(map(len, clean.values()))
    print("share of the words of edited passages cut:", gone, "of clean words:", lost)
    assert gone >= 0.9 and lost <= 0.005
    assert all(got[k] == words(t) for k, t in rows if k % 2 == 0)


def test_buckets_of_many_kinds_lose_no_link(spark):
    """Thousands of paragraphs that share one passage but hold different others: all pairs at the threshold are linked."""
    shared_part = prose(45)
    kinds = [prose(60) for _ in range(40)]
    rows = [(k, f"{shared_part} {kinds[k % 40]}") for k in range(160)]
    got = P.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(bool(words(r.text)) for r in got) == 40 and all(r.text == dict(rows)[0] for r in got if r.doc_id == 0)


def test_columns_with_the_names_used_inside(spark):
    p = prose(90)
    df = spark.createDataFrame([(1, p, 1, 2, "a", 3), (2, "x " + p, 1, 2, "b", 4)], "doc_id long, text string, _doc int, _key int, spans string, row int")
    out = {r.doc_id: r for r in P.cut(df).collect()}
    assert P.cut(df).columns == df.columns and out[1].text == p and out[2].text == "x" and (out[2].spans, out[2].row, out[2]._key) == ("b", 4, 2)


def test_pasted_passages_go_and_clean_texts_stay(spark):
    line = "a common line of eight words in all."
    texts = {k: prose(80) + "\n" + line + "\n" + prose(60) for k in range(60)}
    for g in range(8):
        passage = prose(52 + 12 * g)
        for k in range(g, g + 4 * 5, 5):
            w = texts[k].split(" ")
            at = RND.randrange(len(w))
            texts[k] = " ".join([*w[:at], passage, *w[at:]])
    near = prose(200).split()
    texts[100] = " ".join(near)
    near[100] = "changed"
    texts[101] = " ".join(near)
    df = spark.createDataFrame([(k, t, len(t), "s") for k, t in texts.items()], "doc_id long, text string, n_chars long, spans string")
    assert len(shared(texts)) > 20
    after = {r.doc_id: r for r in P.cut(df).collect()}
    assert set(after) == set(texts) and df.columns == P.cut(df).columns
    assert not shared({k: r.text for k, r in after.items()})
    assert all(r.n_chars == len(r.text) for r in after.values())
    for k in set(texts) - shared(texts) - {101}:
        assert after[k].text == texts[k]
    assert after[100].text == texts[100] and len(words(after[101].text)) < 60


def test_odd_rows(spark):
    p = prose(90)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, p, "x"), (4, p, "x"), (5, prose(5) + " " + p, "x"), (None, p, "x"), (6, "to be " * 40_000, "x"), (7, "to be " * 30_000, "x"), (8, "kurz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: r for r in P.repeats(df).collect()}
    assert set(got) >= {5} and not set(got) & {1, 2, 3, 4, 8, None} and got[5].kept_in == [4]
    out = P.cut(df).collect()
    assert len(out) == len(rows) and sorted(r.text or "" for r in out if r.doc_id in (4, None)) == [p] * 3
    assert P.repeats(df.limit(0)).collect() == [] and P.cut(df.limit(0)).collect() == []


def test_query_finds_what_brute_force_finds(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op3_passages"](spark, SF).collect()
    cut = dict(texts)
    for r in rows:
        raw, at, out = texts[r.doc_id].encode(), 0, []
        for s in r.spans:
            out.append(raw[at : s["from"]])
            at = s["to"]
        cut[r.doc_id] = b"\n".join([*out, raw[at:]]).decode()
    before, after = shared(texts), shared(cut)
    assert before and len(after) <= 0.03 * len(before)
    assert all(set(r.kept_in) != {r.doc_id} and r.n_words >= P.LEAST_RUN for r in rows)
