"""Registered queries of text read off images. Imported by ``queries`` last, whose registry it fills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldweave.operators import read_lines as RL
from fieldweave.plans.queries import query

TEXTS = ["X", "Sum", "2O25-1-3", "Cуммa", "12O,5S", "--", "Search it", "TOTAL AMOUNT", "aaaa", "l.O2.2025", "plain words", "№", "ok", "http://x", "7", "2025/02/31"]


def pieces(table):
    """A user's events as pieces of text on pages."""
    e = table("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    text = F.get(F.array(*[F.lit(x) for x in TEXTS]), F.pmod(F.col("event_id") * 5 + F.floor("value").cast("long"), F.lit(len(TEXTS))).cast("int"))
    return e.select(
        F.col("user_id").cast("long").alias("doc_id"), F.col("event_id").cast("long").alias("pos"), F.floor(F.col("n") / 30).cast("long").alias("page"), F.when(F.col("event_type") != "signup", F.floor("value") * 3).cast("double").alias("x"),
        (F.floor(F.col("n") % 30 / 5) * 11 + F.col("event_id") % 3).cast("double").alias("y"), (F.col("event_id") % 40 + 5).cast("double").alias("width"), F.lit(9.0).alias("height"), text.alias("text"), F.round(F.least(F.col("value") / 60, F.lit(1.0)), 4).alias("confidence"), F.when(F.col("event_type") == "click", 0.9).otherwise(1.0).alias("weight"),
    )


@query
def l19_joined_pieces(table):
    return RL.joined_pieces(pieces(table))


@query
def l20_best_readings(table):
    images = table("events").groupBy(F.col("user_id").cast("long").alias("doc_id")).agg(F.lit(70).alias("image_height"), (F.min("event_id") % 2 == 0).alias("screenshot"))
    return RL.best_readings(pieces(table), images).select("doc_id", "pos", "text", "x", "y")


@query
def l21_page_rows(table):
    return RL.page_rows(pieces(table))
