"""Proportional stratified interleaving into shards.

Rows of each source are put in a seeded random order; the k-th of n rows has the fractional rank (k - 1/2) / n. Sorted by
fractional rank, every stretch of rows holds the sources in the proportions of the whole table, so cutting that order into
equal stretches gives shards that all match the mixture: of each source, each shard has its share rounded down or up, give
or take one. The law held is ``rows``: shard sizes differ by at most one row.

Both orders are found without sorting any source or the table in one task: rows fall into buckets by the leading part of
their sort key, buckets are counted (partial counts before the shuffle), and a row's rank is the count of the buckets before
its own plus its rank within it. A source with a third of all rows is spread over the buckets like any other; their number grows with the
table, so that one holds ``BUCKET_ROWS`` rows on average at most. The draw is by doc_id, size and checksum, so that rows without an id do not share one.

Defined cases: null text counts as no bytes; a null source is a source of its own; rows that are alike in doc_id, size and
checksum are interchangeable and get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.workspace import stored

SHARDS = 40
SEED = "mixture-1"
ROW_BYTES = 16
DEALS, BUCKET_ROWS = 4096, 250_000


def interleaved(documents: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard and slot for every row."""
    deals = max(DEALS, documents.count() // BUCKET_ROWS)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    rows = rows.withColumn("draw", F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")), 1, 16))
    rows = rows.withColumn("deal", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * deals / float(1 << 32)).cast("int"))
    tie = ["draw", "doc_id", "size", "text_crc32"]

    counts = rows.groupBy("stratum", "deal").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("stratum")
    before = counts.select(
        "stratum",
        "deal",
        (F.sum("n").over(by_source.orderBy("deal")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("of_source"),
    )
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "deal").orderBy(*tie))
    placed = rows.join(before, ["stratum", "deal"]).withColumn("fraction", (rank - 0.5) / F.col("of_source"))
    placed = stored(placed.drop("deal", "before", "of_source").withColumn("stretch", F.floor(F.col("fraction") * deals).cast("int")), "placed")

    counts = placed.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))  # as many rows as buckets
    everything = Window.partitionBy(F.lit(0))
    before = counts.select("stretch", (F.sum("n").over(everything.orderBy("stretch")) - F.col("n")).alias("before"), F.sum("n").over(everything).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("stretch").orderBy("fraction", "stratum", *tie)) - 1
    return (
        placed.join(before, "stretch")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"place * {shards} div total"))
        .withColumn("slot", F.expr(f"place - (shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "fraction", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )
