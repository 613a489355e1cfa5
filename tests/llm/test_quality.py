import re

import numpy as np
import pytest

from fieldweave.llm import quality as Q
from fieldweave.llm import queries

SF = "/root/testdata/sf0.01"


def test_expectation_maximisation_recovers_accuracies():
    rnd = np.random.default_rng(4)
    truth = rnd.random(20_000) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.99])
    votes = np.where(rnd.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rnd.random(votes.shape) < 0.3] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.where((patterns == 1).sum(axis=1) > (patterns == 0).sum(axis=1), 0.8, 0.2)
    post, found = Q.expectation_maximisation(patterns, counts, start)
    assert abs(found["prior"] - 0.3) < 0.03
    assert np.allclose(found["rates"][:3, 1, 1], right[:3], atol=0.04) and np.allclose(found["rates"][:3, 0, 0], right[:3], atol=0.04)
    assert ((post[inverse] > 0.5) == truth).mean() > 0.95


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op1_quality"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    import zlib

    held = [r for r in got if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % Q.FOLDS == Q.HELD_OUT]
    clean = [r for r in held if labels[r.doc_id].quality and not labels[r.doc_id].toxic]
    low = [r for r in held if not labels[r.doc_id].quality]
    toxic = [r for r in held if labels[r.doc_id].toxic]
    print("held out: clean kept", sum(r.kept for r in clean), "of", len(clean), "low dropped", sum(not r.kept for r in low), "of", len(low), "toxic dropped", sum(not r.kept for r in toxic), "of", len(toxic))
    assert sum(r.kept for r in clean) / len(clean) > 0.95
    assert sum(not r.kept for r in low) / len(low) > 0.85
    assert sum(not r.kept for r in toxic) / len(toxic) >= 0.6


def test_without_ids_the_posterior_of_the_votes_decides(spark):
    good = "the sea and the land are plain and calm in this part of the world for all that is known "
    docs = [(None, good * (k % 3 + 1)) for k in range(30)] + [(None, "spam*** spam*** spam*** spam*** spam***")] * 10 + [(None, good + "you are an idiot and a stupid moron")] * 10 + [(None, None)]
    rows = Q.assess(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 51 and sum(r.kept for r in rows) == 30


def plain_facts(text):
    """Votes of the toxicity labellers and shares, word by word."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    low = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
    solid = lambda c: c.isascii() and c.isalnum() or not c.isascii()
    core = ["".join(w[min(k for k, c in enumerate(w) if solid(c)) : max(k for k, c in enumerate(w) if solid(c)) + 1]) if any(map(solid, w)) else "" for w in low]
    english = sum(w in Q.COMMON for w in core) / max(1, len(words))
    vote = lambda listed: 1 if any(w in listed for w in core) else 0 if english >= Q.ENGLISH else -1
    repeated = sum(a == b for a, b in zip(low[1:], low[:-1], strict=True)) / max(1, len(words))
    return (vote(Q.NOUNS), vote(Q.ADJECTIVES)) if words else (-1, -1), repeated


def test_votes_equal_a_plain_count(spark):
    """The labellers over the whole small table against a word-by-word count."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["", "IDIOT!", "a stupid, the the the", "…"]
    raw = [t.encode() for t in texts]
    f = Q.Facts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        votes, repeated = plain_facts(t)
        assert tuple(f.votes()[k, Q.QUALITY_LABELLERS :]) == votes and abs(f.shares[k, 0] - repeated) < 1e-12


def test_scores_equal_a_plain_sum(spark):
    """Every row of the query against the fitted weights added up word by word."""
    rnd = np.random.default_rng(1)
    scorer = Q.Scorer(rnd.normal(size=(2, Q.BUCKETS + 1)).astype(np.float32), rnd.normal(size=(2, len(Q.RULES) + 1)), np.array([0.1, -0.2]))
    scorer.weights[:, -1] = 0
    texts = ["plain words about idiots", "", "x", "longer beginnings matter, here!"]
    raw = [t.encode() for t in texts]
    f = Q.Facts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got, grams = scorer.probabilities(f), list(f.buckets())
    for k, t in enumerate(texts):
        n = len(t.split())
        for a in (0, 1):
            z = sum(float(scorer.weights[a, g[w]]) for g in grams for w in range(f.words.first[k], f.words.last[k])) / max(1, n) ** 0.5 + float(Q.dense_features(f)[k] @ scorer.dense[a]) + scorer.bias[a]
            assert abs(got[a, k] - ((1.0, 0.0)[a] if n == 0 else 1 / (1 + np.exp(-z)))) < 1e-5


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, "A plain text about the sea and the land."), (5, "spam*** spam*** spam*** spam***"), (6, "you are an idiot and a moron in the end"), (None, "A plain text about the sea."), (7, "word " * 50_000), (4, "A plain text about the sea and the land.")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 0), (6, 1, 1), (99, 1, 1), (7, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = Q.assess(df, labels).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: r for r in rows}
    assert [got[k].kept for k in (1, 2, 3)] == [False] * 3 and got[1].p_low_quality == 1
    assert all(0 <= r.p_low_quality <= 1 and 0 <= r.p_toxic <= 1 for r in rows)
    assert Q.assess(df.limit(0), labels).collect() == []
    assert len(Q.assess(df, labels.limit(0)).collect()) == len(docs)
    assert [r.kept for r in Q.assess(df.where("doc_id < 3"), labels).collect()] == [False, False]


@pytest.mark.parametrize("text,column", [("ha ha ha ha ha ha", 0), ("one## two## three##", 1), ("LOUD NOISE HERE", 2), ("no!! way!! man!!", 3), ("a | b | c | d", 4)])
def test_shares(text, column):
    raw = np.frombuffer(text.encode(), np.uint8)
    f = Q.Facts(raw, np.array([0, len(raw)]))
    assert f.shares[0, column] >= Q.RULES[column][1] and f.votes()[0, 0] == 1
