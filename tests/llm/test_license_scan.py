import random
import re

import numpy as np

from fieldweave.llm import license_scan as L
from fieldweave.llm import queries
from fieldweave.llm.license_texts import TEMPLATES

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence_and_near_the_longest():
    rnd = random.Random(1)
    for _ in range(200):
        b = [rnd.randrange(30) for _ in range(rnd.randrange(1, 25))]
        a = [x for x in b if rnd.random() > 0.2]
        for _ in range(rnd.randrange(6)):
            a.insert(rnd.randrange(len(a) + 1), rnd.randrange(40))
        pairs = L.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
        if b and len(set(b)) == len(b) and set(a) <= set(b) and len(set(a)) == len(a):
            assert len(pairs) == lcs(a, b)
    assert L.aligned([], [1]) == [] and L.increasing([]) == []


def scan(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    return sorted(((r.doc_id or 0, r.license, round(r.coverage, 2), r.first_word, r.end_word) for r in L.scan(df, **kw).collect()))


def test_notices_texts_and_odd_rows(spark):
    mit, notice = TEMPLATES["MIT"], TEMPLATES["MIT-notice"]
    words = mit.split()
    changed = " ".join(w for k, w in enumerate(words) if k % 12)
    filler = "the of is under a work this " * 3000
    got = scan(spark, [(1, None), (2, ""), (3, f"Some words.\n{notice}\nMore words."), (4, f"{filler}\n{mit} {filler}"), (5, changed), (6, f"{notice} {notice}"), (None, notice), (7, "Released under a licence of sorts"), (8, notice.upper())])
    assert (3, "MIT-notice", 1.0, 2, 7) in got and (0, "MIT-notice", 1.0, 0, 5) in got and (8, "MIT-notice", 1.0, 0, 5) in got
    assert (4, "MIT", 1.0, 21000, 21000 + len(words)) in got
    assert [r for r in got if r[0] == 5][0][1] == "MIT" and 0.85 < [r for r in got if r[0] == 5][0][2] < 0.95
    assert [r[3:] for r in got if r[0] == 6] == [(0, 5), (5, 10)]
    assert not [r for r in got if r[0] in (1, 2, 7)]
    assert scan(spark, []) == [] and scan(spark, [(1, notice)], templates={"x": "other words entirely"}) == []


def test_copies_in_a_row_are_all_found(spark):
    for name, text in TEMPLATES.items():
        n = len(text.split())
        few = " ".join(w for k, w in enumerate(text.split()) if n < 20 or k % 12 != 5)
        m = len(few.split())
        got = scan(spark, [(k, "one two three four five " + " ".join([t] * k) + " six seven eight nine ten") for k, t in ((2, text), (3, text))] + [(4, " ".join([few] * 4))], templates={name: text})
        assert sorted((r[0], *r[2:]) for r in got if r[0] < 4) == [(c, 1.0, 5 + k * n, 5 + (k + 1) * n) for c in (2, 3) for k in range(c)]
        ends = sorted(r[3:] for r in got if r[0] == 4)  # a word that a copy lacks may be the neighbour's
        assert len(ends) == 4 and all(abs(a - k * m) <= 0.15 * n and abs(b - (k + 1) * m) <= 0.15 * n for k, (a, b) in enumerate(ends))


def test_longest_common_subsequence_of_repeated_words():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 90))] for _ in range(2))
        pairs = L._common(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_query_finds_all_notices_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {(r.doc_id, r.license) for r in queries.QUERIES["op9_license_scan"](spark, SF).collect()}
    want = set()
    for name, t in TEMPLATES.items():
        if name.endswith("notice"):
            want |= {(r.doc_id, name) for r in docs if re.search(re.escape(t), r.text)}
    assert want and want <= got and len(got - want) <= 0.05 * len(want)


def test_cores_of_a_slice():
    raw = "(The) the, -- “É”".encode()
    _, h = L.cores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert h[0] == h[1] and len(h) == 4
