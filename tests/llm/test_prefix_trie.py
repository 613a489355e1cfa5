import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from fieldweave.llm import prefix_trie as P
from fieldweave.llm import workspace as W

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    members, ending = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ending[tuple(whole)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = set(), {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in children[p]) or 1, saved + sum(sums[k][1] for k in children[p]))
        sha = hashlib.sha256(",".join(map(str, sorted(ending[p]))).encode()).hexdigest()
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *sums[p], sha))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn int, role string, text string, depth int").repartition(3)
    got = P.trie(df).select(*COLUMNS).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def random_rows(rnd, n, kinds=3, most=6):
    rows = []
    for c in range(n):
        rows += [(c, t, rnd.choice("ua"), f"{'w ' * rnd.randrange(3)}{rnd.randrange(kinds)}") for t in range(rnd.randrange(1, most))]
    return rows


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "x"), (2, 0, "u", "x y"), (2, 0, "u", "x y"), (2, 0, "a", "tie"), (None, 1, "u", "no id"), (-7, 0, "u", "neg"), (-20, 0, "u", "base"), (45, 0, "u", ""), (40, 3, "u", "w " * 50_000), (41, 0, "u", "w " * 50_000), (300, 0, "u", "only one"), (301, 0, "u", "only one")]
    rows += [(60, t, "u", f"t{t}") for t in range(5)] + [(c, 0, "u", "short") for c in range(61, 80)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, 1, "u", "x")])
    check(spark, [(5, 1, "u", "x")])


@pytest.mark.parametrize(("component", "together"), [(50_000, 20_000), (40, 7), (1, 20_000)])
def test_equals_the_definition(spark, monkeypatch, component, together):
    """With large and small components, in joins and in tasks, and with keys that are hot from a few rows on."""
    monkeypatch.setattr(P, "COMPONENT", component)
    monkeypatch.setattr(W, "TOGETHER", together)
    monkeypatch.setattr(P, "IDS_CHARS", 64)
    rnd = random.Random(component)
    rows = random_rows(rnd, 60)
    rows += [(1000 + c, t, "u", f"same {t}") for c in range(70) for t in range(3)]  # copies, of which many end at one node
    rows += [(2000, t, "u", f"long {t % 3}") for t in range(90)] + [(2001, t, "u", f"long {t % 3}") for t in range(70)]
    check(spark, rows)


def test_a_long_conversation_is_dealt_over_partitions(spark):
    """Places and prefixes of one conversation that spans many partitions equal those of a plain fold."""
    rows = spark.createDataFrame([(7, t, t * 31 + 1, t ^ 5) for t in range(5000)] + [(8, 1, 4, 4), (6, 2, 3, 3)], "conv_id long, turn int, x long, y long")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    got = P.running(rows, ["turn"], "rows").where("conv_id = 7").orderBy("turn").collect()
    x = y = 0
    for t, r in enumerate(got):
        x, y = x ^ (t * 31 + 1), y ^ t ^ 5
        assert (r.at, r.x, r.y) == (t + 1, x, y)


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar"])
def test_decomposition_of_trees(shape):
    rnd = random.Random(3)
    n = 400
    parent = [-1] + [{"path": v - 1, "star": 0, "random": rnd.randrange(v), "caterpillar": v - 1 if v % 2 else max(0, v - 2)}[shape] for v in range(1, n)]
    weight, value = [1] * n, [rnd.randrange(9) for _ in range(n)]
    want = list(value)
    for v in range(n - 1, 0, -1):
        weight[parent[v]] += weight[v]
        want[parent[v]] += want[v]
    assert P.decompose(parent, weight, [value]) == [want]
