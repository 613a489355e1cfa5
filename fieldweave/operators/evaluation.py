"""Accuracy by category, on/off deltas, run status, dataset snapshots, feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(cases: DataFrame, category: str, right: str) -> DataFrame:
    """Share of right cases by category and over all (NULL)."""
    return cases.rollup(category).agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col(right).cast("int")).alias("accuracy"))


def outcomes(cases: DataFrame, category: str, expected: str, got: str) -> DataFrame:
    """Exact, false-positive and unresolved counts and precision (NULL if nothing was resolved) by category."""
    e, g = F.col(expected), F.col(got)
    out = cases.groupBy(category).agg(
        F.count_if(g.isNotNull() & (g == e)).alias("exact"),
        F.count_if(g.isNotNull() & ~g.eqNullSafe(e)).alias("false_positive"),
        F.count_if(g.isNull()).alias("unresolved"),
        F.count_if(g.eqNullSafe(e)).alias("correct_outcome"),
    )
    return out.withColumn("precision", F.try_divide(F.col("exact"), F.col("exact") + F.col("false_positive")))


def deltas(off: DataFrame, on: DataFrame, key: str, right: str) -> DataFrame:
    """Each case's outcome with the feature on against off: improved, regressed or unchanged."""
    both = off.select(key, F.col(right).alias("off")).join(on.select(key, F.col(right).alias("on")), key)
    return both.select(key, F.when(F.col("on") & ~F.col("off"), "improved").when(F.col("off") & ~F.col("on"), "regressed").otherwise("unchanged").alias("outcome"))


def run_status(runs: DataFrame) -> DataFrame:
    """high, medium or low readiness from fields, unresolved and suggested counts."""
    fields, unresolved, suggested = F.col("fields"), F.col("unresolved"), F.col("suggested")
    ratio = F.when(fields > 0, F.greatest(fields - unresolved, F.lit(0)) / fields).otherwise(1.0)
    review = F.when(fields > 0, (suggested + unresolved) / fields).otherwise(0.0)
    status = F.when((ratio >= 0.9) & (unresolved == 0) & (review <= 0.35), "high").when((ratio >= 0.7) & (unresolved <= F.greatest(F.lit(1), F.floor(fields / 4))), "medium").otherwise("low")
    return runs.withColumn("resolved_ratio", F.round(ratio, 4)).withColumn("review_ratio", F.round(review, 4)).withColumn("status", status)


def curated(items: DataFrame, quality: Column) -> DataFrame:
    """Items good enough to learn from, their review status and split."""
    q = items.withColumn("quality_score", quality).where(F.col("quality_score") >= 0.72)
    return q.withColumn("status", F.when(F.col("quality_score") >= 0.92, "approved").otherwise("candidate")).withColumn("split", F.when(F.col("quality_score") >= 0.85, "train").otherwise("validation"))


def snapshot(items: DataFrame, least: float, statuses: list[str]) -> DataFrame:
    """Count of items, least and greatest id and identity by split: the sums of the halves of the ids' MD5, free of order."""
    chosen = items.where((F.col("quality_score") >= least) & F.col("status").isin(statuses)).withColumn("_md5", F.md5(F.col("id").cast("string")))
    half = lambda at: F.sum(F.conv(F.substring("_md5", at, 8), 16, 10).cast("long"))  # noqa: E731  an eighth of a hash: 2**31 ids fit
    identity = F.concat_ws("-", *[half(at).cast("string") for at in (1, 9, 17, 25)])
    return chosen.groupBy("split").agg(F.count(F.lit(1)).alias("items"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), identity.alias("identity"))


# What a training example asks for.
TASKS = {
    "draft_json": "Generate a canonical draft JSON schema from table columns and user-confirmed naming patterns. Return only JSON.",
    "mapping": "Resolve semantic mappings between source table fields and target JSON fields using domain-consistent synonyms. Return only JSON.",
}


def training_examples(items: DataFrame) -> DataFrame:
    """Items (id, item_kind, split, quality_score, input_payload, target_payload: canonical JSON) as training examples with task_type and messages.

    A template, and an item whose target has a ``draft_json``, asks for a draft and is answered by it; all others ask for a mapping. A payload that
    is no JSON object is wrapped as ``raw_input`` or ``raw_target``.
    """
    wrapped = lambda c, raw: F.when(F.col(c).rlike(r"(?s)^\s*\{.*\}\s*$"), F.col(c)).otherwise(F.concat(F.lit('{"' + raw + '":'), F.when(F.col(c).rlike(r"^\s*(?:\[|\"|-?\d|true|false|null)"), F.col(c)).otherwise(F.to_json(F.col(c).try_cast("variant"))), F.lit("}")))
    rows = items.withColumns({"input_payload": wrapped("input_payload", "raw_input"), "target_payload": wrapped("target_payload", "raw_target")})
    draft = F.get_json_object("target_payload", "$.draft_json")
    task = F.when(draft.isNotNull() | (F.col("item_kind") == "template"), "draft_json").otherwise("mapping")
    ask = F.when(F.col("task_type") == "draft_json", TASKS["draft_json"]).otherwise(TASKS["mapping"])
    answer = F.when(F.col("task_type") == "draft_json", F.coalesce(draft, F.col("target_payload"))).otherwise(F.col("target_payload"))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(said("system", ask), said("user", F.col("input_payload")), said("assistant", answer))
    return rows.withColumn("task_type", task).select("id", "task_type", "item_kind", "split", F.round("quality_score", 4).alias("quality_score"), "input_payload", "target_payload", messages.alias("messages"))


KINDS = [["csv"], ["xlsx", "xls"], ["pdf", "docx"]]


def feature_vectors(runs: DataFrame, tokens: int = 48) -> DataFrame:
    """id, vector, l2_norm and token bag (a map of counts) of runs.

    ``runs``: id, sources and targets (arrays of normalised names in order, with repeats), rows, sheets, high, medium, low, none, warnings, file_type.
    The vector's 13 parts: capped counts of sources, targets, rows and sheets; the overlap of distinct names; the shares of the four confidence
    bands; capped warnings; the three groups of file types. The bag counts the first ``tokens`` names of either side and the file type.
    """
    capped = lambda n, most: F.round(F.least(n, F.lit(most)) / most, 6)
    names = F.size(F.array_union("sources", "targets"))
    overlap = F.round(F.size(F.array_intersect("sources", "targets")) / F.greatest(names, F.lit(1)), 6)
    mappings = F.greatest(F.col("high") + F.col("medium") + F.col("low") + F.col("none"), F.lit(1))
    bands = [F.round(F.col(b) / mappings, 6) for b in ("high", "medium", "low", "none")]
    kinds = [F.col("file_type").isin(k).cast("double") for k in KINDS]
    vector = F.array(capped(F.size("sources"), 64), capped(F.size("targets"), 64), capped(F.col("rows"), 10), capped(F.col("sheets"), 10), overlap, *bands, capped(F.col("warnings"), 10), *kinds)
    words = F.concat(_tagged("sources", "source:", tokens), _tagged("targets", "target:", tokens), F.array(F.concat(F.lit("file_type:"), "file_type")))
    rows = runs.select("id", vector.alias("vector"), F.array_sort(words).alias("words")).withColumn("l2_norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))
    bag = F.map_from_entries(F.transform(F.array_distinct("words"), lambda w: F.struct(w, F.size(F.filter("words", lambda x: x == w)))))  # at most 2 * tokens + 1 words
    return rows.select("id", "vector", "l2_norm", bag.alias("tokens"))


def _tagged(side: str, name: str, most: int) -> Column:
    return F.transform(F.slice(side, 1, most), lambda x: F.concat(F.lit(name), x))


def graph_deltas(off: DataFrame, on: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id and the changes of exact, false-positive and unresolved rates between two evaluations (case_id, exact, false_positive, unresolved).

    Every case of ``cases`` (case_id) or of either evaluation has a row; the rates of a missing evaluation are 0.
    """
    rates = ["exact", "false_positive", "unresolved"]
    signed = [run.select("case_id", *[(F.coalesce(r, F.lit(0.0)) * sign).alias(r) for r in rates]) for run, sign in ((off, F.lit(-1.0)), (on, F.lit(1.0)))]
    none = cases.select("case_id", *[F.lit(0.0).alias(r) for r in rates])
    return signed[0].unionByName(signed[1]).unionByName(none).groupBy("case_id").agg(*[F.round(F.sum(r), 4).alias(f"{r}_delta") for r in rates])
