from collections import Counter

from pyspark.sql import functions as F

from fieldweave.llm.workspace import drawn


def test_draws_exactly_n_of_large_strata_and_all_of_small_ones(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("kind"))
    got = drawn(rows, "kind", 500).collect()
    assert Counter(r.kind for r in got) == {"large": 500, "small": 200}
    assert {r.doc_id for r in got} == {r.doc_id for r in drawn(rows.repartition(7), "kind", 500).collect()}
    assert drawn(rows.limit(0), "kind", 5).collect() == []
    first = drawn(rows.withColumn("new", F.col("doc_id") % 10 == 3), "kind", 100, first=[F.col("new").desc()]).where("kind = 'large'").collect()
    assert len(first) == 100


def test_hot_nodes_are_dealt_and_joins_lose_no_row(spark, monkeypatch):
    """With hot keys from three rows on, components equal a plain union of sets and a dealt join a plain join."""
    import random

    from fieldweave.llm import components as C
    from fieldweave.llm import workspace as W

    monkeypatch.setattr(C, "TOGETHER", 3)
    monkeypatch.setattr(W, "TOGETHER", 3)
    rnd = random.Random(2)
    pairs = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(25)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {n: min(m for m in root if top(m) == top(n)) for n in root}
    got = {r.id: r.component for r in C.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    many = W.stored(spark.createDataFrame([(k % 4 if k % 3 else 0, k) for k in range(100)], "key long, row long"), "many")
    few = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (9, "d")], "key long, name string")
    assert sorted(map(tuple, W.spread_join(many, few, "key", ["row"]).select("key", "row", "name").collect())) == sorted(map(tuple, many.join(few, "key").select("key", "row", "name").collect()))
