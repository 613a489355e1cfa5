import functools
import random

import numpy as np
import pytest
import sentencepiece

from fieldweave.llm import queries as Q
from fieldweave.llm import sentencepiece_codec as S

SF = "/root/testdata/sf0.001"


@functools.cache
def codec():
    return S.Codec(S.load(S.model_path()))


def rows(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def brute(text):
    """Viterbi over the whole text, character by character, from the definition."""
    c = codec()
    if not text:
        return [], 0.0
    by = {c.v.pieces[i]: int(i) for i in c.v.matched}
    most = max(map(len, by))
    x = (" " + text.replace(S.MARKER, " "))
    ends = np.cumsum([0, *(len(ch.encode()) for ch in x)]).tolist()
    raw = x.encode()
    best = {0: (0.0, [])}
    for k in range(1, len(ends)):
        e, found = ends[k], None
        for j in range(k):  # the longest last piece first
            s = ends[j]
            if e - s <= most and raw[s:e] in by:
                i = by[raw[s:e]]
                score = best[s][0] + c.v.scores[i]
                if found is None or score > found[0]:
                    found = (score, [*best[s][1], i])
        s = ends[k - 1]
        score = best[s][0] + c.penalty
        if found is None or score >= found[0]:
            found = (score, [*best[s][1], *(int(c.v.byte_ids[b]) for b in raw[s:e])])
        best[e] = found
    return best[len(raw)][1], best[len(raw)][0]


TEXTS = ["", "a", " ", "Hello  world\nfoo\tbar ", "   leading", "naïve Ørsted 中文 жук \U0001f600!", "▁x▁▁y", "x" * 300, "\n\n\n", "tail   ", "İstanbul\u0000z", "ab́c"]


def test_equals_brute_force_and_round_trips():
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("the an\n é中.\U0001f600zq") for _ in range(rnd.randrange(60))) for _ in range(60)]
    ids, bounds, score = codec().encode(*rows(texts))
    data, offs = codec().decode(ids, bounds)
    for k, t in enumerate(texts):
        want, best = brute(t)
        assert score[k] == pytest.approx(best)
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, t
        assert data[offs[k] : offs[k + 1]].tobytes().decode() == t.replace(S.MARKER, " ")


def test_library_decodes_the_query_to_the_texts(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = Q.QUERIES["op2_sentencepiece"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    library = sum(len(m.encode(t or "")) for t in docs.values())
    assert 0.9 * library < sum(r.n_tokens for r in got) < 1.02 * library  # no more tokens than the merges make
    for r in got:
        assert r.round_trip and r.n_tokens == len(r.ids) and m.decode(r.ids) == docs[r.doc_id]
        if len(docs[r.doc_id]) < 400:
            assert r.ids == brute(docs[r.doc_id])[0]


def test_columns_on_odd_rows(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (None, "a b", "x"), (5, "word " * 60_000, "x"), (6, "x" * 3000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    enc = S.encode(df)
    got = {r.doc_id: r for r in enc.collect()}
    assert got[1].ids == got[2].ids == [] and got[3].ids == got[None].ids and all(r.round_trip for r in got.values())
    assert {r.doc_id: r.text for r in S.decode(enc).collect()} == {k: t or "" for k, t, _ in data}
    assert S.encode(df.limit(0)).collect() == []
