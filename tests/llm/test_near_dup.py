import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldweave.llm import near_dup as N
from fieldweave.llm.components import connected_components


def brute(rows):
    """doc_id -> (distinct sizes, component) from exact sets of all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(root)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in root}, sets


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component long")
    got = N.near_duplicates(df).collect()
    want, sets = brute(rows)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(s)) for i, v in sets.items() for s in v)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "one two"), (None, "one two"), (None, None), (8, long), (9, long + " end"), (8, long), (10, "a b c d e"), (10, "p q r s t"), (11, "P q r s t"), (12, "a b c d e"), (13, "É é É é É é")])
    check(spark, [(5, "a b c d e f"), (3, "a b c d e f")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("block", [256, 4])
def test_groups_of_near_copies_equal_brute_force(spark, monkeypatch, block):
    """Chains of drifting copies, whose ends are not similar, and a passage that many texts share."""
    monkeypatch.setattr(N, "BLOCK", block)
    rnd = random.Random(3)
    rows, i = [], 100
    passage = " ".join(f"p{k}" for k in range(40))
    for g in range(6):
        words = [f"g{g}w{rnd.randrange(400)}" for _ in range(60)]
        for _ in range(12):
            words = list(words)
            words[rnd.randrange(60)] = f"x{i}"
            rows.append((i, " ".join(words)))
            i += 1
    for _ in range(40):
        rows.append((i, passage + " " + " ".join(f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(8, 20)))))
        i += 1
    rnd.shuffle(rows)
    check(spark, rows)


def test_sequential_pruning_keeps_similar_pairs():
    rnd = np.random.default_rng(1)
    n = N.ROWS * N.BANDS
    a = rnd.integers(0, 2**32, (4000, n), dtype=np.uint32)
    b = a.copy()
    b[rnd.random(b.shape) > 0.8] = 0
    assert len(N.surviving(a, b, 0.75)) == 4000
    c = a.copy()
    c[rnd.random(c.shape) > 0.5] = 0
    assert len(N.surviving(a, c, 0.75)) == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    assert {r.id: r.component for r in connected_components(df).collect()} == {k: find(k) for k in root}
    assert connected_components(df.limit(0)).collect() == []
