"""Runs, versions, tokens and uploads: joins, totals, latest versions, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import values as V


def token_totals(turns: DataFrame) -> DataFrame:
    """conv_id, input_tokens, output_tokens, total_tokens, turns: user turns are input, assistant turns output."""
    n = V.token_estimate(F.col("text"))
    out = turns.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "user", n)), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("output_tokens"),
        F.count(F.lit(1)).alias("turns"),
    )
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def run_history(runs: DataFrame, owners: DataFrame, metrics: DataFrame, run: str, owner: str, order: list, newest: int, totals: list) -> DataFrame:
    """The newest runs with their owner and the ``totals`` of their metrics (a run without any keeps NULLs).

    The few newest runs are taken first and only their metrics are read on: the rest is dropped by a broadcast semi-join before anything is grouped.
    """
    top = runs.orderBy(*order).limit(newest)
    own = metrics.join(F.broadcast(top.select(run)), run, "left_semi").groupBy(run).agg(*totals)
    return top.join(owners, owner).join(own, run, "left")


def usage_report(totals: DataFrame, by: str) -> DataFrame:
    """Token sums by ``by`` and over all (NULL) in one pass."""
    return totals.rollup(by).agg(F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def versions(log: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Rows of ``log`` that change ``state``, numbered from 1: a version is kept only if it differs from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = log.withColumn("before", F.lag(state).over(w)).where(~F.col("before").eqNullSafe(F.col(state)) | F.col("before").isNull())
    return changed.withColumn("version", F.row_number().over(w)).drop("before")


def expired(uploads: DataFrame, at: str, now: str, hours: int = 24) -> DataFrame:
    return uploads.where(F.col(at) < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {hours} HOURS"))


def newest_per(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def spread_sample(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each key spread evenly over its order, first and last included; all rows where there are no more than n."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("size") - 1) / (n - 1)).cast("int"))
    return ranked.where((F.col("size") <= n) | F.array_contains(wanted, F.col("i"))).drop("size")
