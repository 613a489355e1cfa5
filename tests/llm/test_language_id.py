import math
import zlib

import numpy as np

from fieldweave.llm import language_id as L
from fieldweave.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.QUERIES["op8_language_id"](spark, SF)
    rows = got.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    taken = [r for r in held if r.accepted]
    assert len(taken) > 0.7 * len(held) and sum(r.lang_pred == r.lang for r in taken) / len(taken) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    data = [(k, t, g, "x") for k, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    data += [(100, None, "en", "x"), (101, "", "de", "x"), (102, "123 !? 45", None, "x"), (None, "the dog", "en", "x"), (103, "der und " * 30_000, None, "x"), (104, "жук", None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.identify(docs, L.fit(docs)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "de" and got[None].lang_pred == "en" and got[None].held_out is False
    assert got[104].lang_pred in ("de", "en")
    empty = docs.limit(0)
    assert L.fit(empty) is None and L.identify(empty, None).collect() == []
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}


def plain_bucket(gram: bytes) -> int:
    n, m = len(gram), 0xFFFFFFFF
    x = (int.from_bytes(gram, "big") ^ (n * 0x5BD1E995 & m)) * 0x9E3779B1 & m
    x = (x ^ x >> 15) * 0x85EBCA77 & m
    return x >> (32 - L.BITS)


def plain_scores(model, text):
    """The definition in plain Python: the mean of the n-grams' rows, then softmax."""
    raw = text.translate({c: c + 32 for c in range(65, 91)}).encode()
    grams = [raw[i : i + n] for n in L.ORDERS for i in range(len(raw) - n + 1)]
    z = [float(b) + sum(float(model.table[plain_bucket(g), k]) for g in grams) / max(1, len(grams)) for k, b in enumerate(model.bias)]
    e = [math.exp(v - max(z)) for v in z]
    return {name: v / sum(e) for name, v in zip(model.languages, e, strict=True)}


def test_query_equals_a_plain_count(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs)
    monkeypatch.setattr(L, "BLOCK", 50)  # sums in blocks equal whole sums
    raw = [(r.text or "").encode() for r in docs.orderBy("doc_id").collect()]
    offs = np.cumsum([0, *map(len, raw)])
    blocks = L.scores(model, np.frombuffer(b"".join(raw), np.uint8), offs)
    rows = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for k, d in enumerate(docs.orderBy("doc_id").collect()):
        text = d.text or ""
        if len(text) > 3000:
            continue
        p = plain_scores(model, text)
        assert np.allclose(blocks[k], [p[n] for n in model.languages], atol=1e-5)
        letter = any(c.isalpha() for c in text)
        best = max(p, key=p.get)
        assert rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert rows[d.doc_id].lang_pred == (best if letter else "und") or abs(sorted(p.values())[-1] - sorted(p.values())[-2]) < 1e-5
        assert abs(rows[d.doc_id].score - (p[best] if letter else 0)) < 1e-5


def test_equal_scores_and_one_language(spark):
    one = spark.createDataFrame([(k, "la la la", "xx") for k in range(40)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in L.identify(one, L.fit(one)).collect()} == {("xx", 1.0)}
    two = spark.createDataFrame([(k, "same text", ("aa", "bb")[k % 2]) for k in range(60)], "doc_id long, text string, lang string")
    assert len({(r.lang_pred, r.score) for r in L.identify(two, L.fit(two)).collect()}) == 1
