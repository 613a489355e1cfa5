"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder is made only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = tempfile.mkdtemp(prefix="fieldweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound of 10,000 rows can be a great many bytes of long texts
BATCH_BYTES = 4 << 20


def lean(df: DataFrame) -> SparkSession:
    """The session of ``df``, whose Arrow batches are bounded by BATCH_BYTES from here on (a lower bound of the user's stays)."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(key).lower())
    unit = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}.get(have[2]) if have else None
    if unit is None or int(have[1]) << unit > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of narrow keys (a few longs) up to which a side is broadcast: some tens of MB in each executor
NARROW_ROWS = 1_000_000


def narrow(keys: DataFrame) -> DataFrame:
    """A stored table of a few longs a row, marked for broadcast if its checked count allows; else joins shuffle it."""
    return F.broadcast(keys) if keys.count() <= NARROW_ROWS else keys


#: Rows of one key up to which a join keeps them together, and the most keys that can have more
TOGETHER, HOT_KEYS = 20_000, 50_000


def spread_join(many: DataFrame, few: DataFrame, on: str, by: list[str]) -> DataFrame:
    """``many`` (a stored table) joined with ``few`` (a row or so for each ``on``), without a hot key in one task.

    Keys with more than ``together`` rows of ``many`` are dealt over parts by a hash of ``by``, and their rows of ``few`` repeated
    for each part. ``together`` grows with the table so that at most HOT_KEYS keys have more: the bound of what is broadcast.
    """
    rows = many.count()
    if rows <= TOGETHER:
        return many.join(few, on)
    together = max(TOGETHER, rows // HOT_KEYS)
    hot = many.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > together).select(on, F.ceil(F.col("_n") / together).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    right = few.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [on, "_part"]).drop("_part")


def drawn(rows: DataFrame, by: str, n: int, first: list | None = None) -> DataFrame:
    """At most ``n`` rows of each ``by``, those of the least hash of doc_id (after the order ``first``, if given).

    Rows are thinned by the hash to a little over n of each stratum before they are ranked, so that ranking never gathers a stratum
    that grows with the table. ``rows`` is read twice.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_of"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    thin = rows.join(narrow(counts), by).where(place * F.col("_of") < n + 6 * n**0.5 + 20)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(first or []), place, "doc_id"))
    return thin.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n", "_of")
