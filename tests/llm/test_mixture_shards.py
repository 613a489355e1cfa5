import zlib
from collections import Counter

from pyspark.sql import functions as F

from fieldweave.llm import mixture_shards as M
from fieldweave.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute(rows, shards, seed):
    """The definition in plain Python: rank in each source, sort by fractional rank, cut."""
    import hashlib

    of = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        draw = hashlib.md5(f"{seed}|{'' if r['doc_id'] is None else r['doc_id']}|{len(raw) + 16}|{zlib.crc32(raw)}".encode()).hexdigest()[:16]
        s = "" if r["source"] is None else "=" + r["source"]
        of.setdefault(s, []).append((draw, -1 if r["doc_id"] is None else r["doc_id"], len(raw) + 16, zlib.crc32(raw)))
    line = sorted(((k + 0.5) / len(v), s, *t) for s, v in of.items() for k, t in enumerate(sorted(v)))
    n = len(line)
    return sorted((x[3], x[4], x[5], at * shards // n, at - -(-(at * shards // n) * n // shards)) for at, x in enumerate(line))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    df = Q.QUERIES["op6_mixture_shards"](spark, SF)
    assert got(df) == brute([r.asDict() for r in rows], 40, M.SEED)
    assert {r.law for r in df.collect()} == {"rows"} and df.where("grown_shard is not null").count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    rows = M.interleaved(docs, shards=8).collect()
    assert set(Counter(r.shard for r in rows).values()) == {125}
    total = Counter(r.source for r in rows)
    for (_, s), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - total[s] / 8) < 2
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(125))


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, shard string"
    data = [(1, "a", "x", "?"), (1, "a", "x", "?"), (None, None, None, None), (2, "", None, "?"), (3, "é" * 50_000, "x", "?"), (4, "b", "", "?")]
    df = spark.createDataFrame(data, schema)
    assert got(M.interleaved(df, shards=3)) == brute([dict(zip(["doc_id", "text", "source"], r, strict=False)) for r in data], 3, M.SEED)
    assert M.interleaved(df.limit(0)).collect() == []
    assert len(M.interleaved(df, shards=40).collect()) == 6
