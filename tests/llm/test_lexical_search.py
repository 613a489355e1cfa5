import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldweave.llm import lexical_search as S

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = set()
    for i, own in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in own if b[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(i, r + 1, d, -s) for r, (s, _, d) in enumerate(scores[:k])}
    return out


def check(spark, docs, items, k=50):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = S.search(df, asked, k).collect()
    assert len(got) == len({(r.item_id, r.rank) for r in got})
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in got} == brute(docs, items, k)


def zipf(rnd, n):
    return " ".join(f"W{int(rnd.paretovariate(0.7)) % 3000}" for _ in range(n))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- \n"), (4, "one, two; ONE"), (5, "two"), (5, "two"), (5, "one two"), (None, "two"), (6, "Éa éa ÉA\x00x"), (7, "x " * 30_000), (8, "one")]
    items = [(1, "one"), (1, "TWO one"), (2, None), (3, "éa"), (4, "nothing"), (None, "one"), (5, "x!x"), (6, "")]
    check(spark, docs, items)
    check(spark, docs, items, k=2)
    check(spark, docs, [])
    check(spark, [], items)
    check(spark, [(1, None)], items)


@pytest.mark.parametrize(("block", "short", "terms_limit"), [(4096, 128, 1 << 17), (200, 5, 40), (90, 1, 1), (64, 10**6, 1 << 17)])
def test_equals_full_scoring(spark, monkeypatch, block, short, terms_limit):
    """Over several index blocks and blocks of items, with no list short, all short, and many ties."""
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    monkeypatch.setattr(S, "SHORT", short)
    monkeypatch.setattr(S, "TERMS", terms_limit)
    rnd = random.Random(block)
    docs = [(k, zipf(rnd, rnd.choice([3, 20, 200]))) for k in range(1500)]
    docs += [(2000 + k, docs[k % 7][1]) for k in range(300)]  # copies: ties at the k-th place
    rnd.shuffle(docs)
    check(spark, docs, [(k, zipf(rnd, 12)) for k in range(12)], k=20)


def test_windows_are_skipped_and_lists_only_looked_up():
    """A high score early leaves later windows and weak lists unread, and the result is the same."""
    rnd = np.random.default_rng(4)
    windows = 32
    strong = np.sort(rnd.choice(windows * S.WINDOW, 300, replace=False))
    weak = np.arange(windows * S.WINDOW)
    lists = [(strong, np.where(strong < 200, 10**6, 5), None), (weak, np.full(len(weak), 10), None)]
    lists = [(d, v, S.window_bounds(d, v, windows)) for d, v, _ in lists]
    best, ids = S.Best(10), np.arange(windows * S.WINDOW)
    read = []
    add = best.add
    best.add = lambda score, doc, known: (read.append(len(doc)), add(score, doc, known))
    S.search_block(lists, windows, best, ids, np.ones(len(ids), bool))
    full = np.where(np.isin(ids, strong), np.where(ids < 200, 10**6, 5), 0) + 10
    assert list(best.doc) == list(np.lexsort((ids, -full))[:10])
    assert sum(read) < 300
