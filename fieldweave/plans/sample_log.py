"""A correction log, suggestions and matching cases made of the ``events`` table, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = {"click": "created date", "view": "total amount", "signup": "customer name", "purchase": "revenue amount", "error": "email"}
TARGETS = ["creationDate", "updateDate", "amount", "name", "revenue", "id", "email"]


def correction_log(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id, source, target, accepted, confidence: a log in the shape of reviewed mappings."""
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("event_type")]
    return events.select(
        "event_id",
        "ts",
        "user_id",
        source.alias("source"),
        F.get(F.array(*[F.lit(t) for t in TARGETS]), k % len(TARGETS)).alias("target"),
        (~((F.col("event_type") == "purchase") & (F.col("value") < 40))).alias("accepted"),
        F.greatest(F.lit(0.6), F.least(F.col("value") / 100, F.lit(1.0))).alias("confidence"),
    )


def suggestions(events: DataFrame) -> DataFrame:
    """run_id (a user's day), user_id, ts, source, target, truth, status, confidence; some wait for review, one in four is the model's."""
    log = correction_log(events)
    status = F.when(F.col("event_id") % 3 == 0, "suggested").when(F.col("accepted"), "accepted").otherwise("rejected")
    truth = F.when(F.col("event_id") % 4 == 0, "model_suggestion").otherwise("deterministic")
    run = F.col("user_id") * 1000 + F.dayofyear("ts")
    return log.select(run.alias("run_id"), "user_id", "ts", F.when(F.col("event_id") % 11 != 0, F.col("source")).alias("source"), "target", truth.alias("truth"), status.alias("status"), "confidence")
