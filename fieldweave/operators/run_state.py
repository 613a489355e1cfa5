"""What becomes of a run's mappings: suggestions, the mappings they stand for, promotion of confirmed runs, and versions of a run's state.

Nothing is updated in place: a run's state is what its log of suggestions and versions says, so a stream of the log gives the same by the same code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import names as N
from fieldweave.functions import values as V
from fieldweave.operators import learning as LE

# What a band counts as a score and where bands begin, and what no run is confirmed by.
SCORES = {"high": 0.95, "medium": 0.7, "low": 0.4}
BANDS = [("high", 0.9), ("medium", 0.6)]
UNCONFIRMED = ["model_suggestion", "position_fallback", "unresolved"]
LEAST_QUALITY = 0.72


def suggestions(mappings: DataFrame) -> DataFrame:
    """Mappings (run_id, pos, user_id, source, target, band, reason, status, truth) as suggestions; those without a run or a target go.

    Without a status a mapping of high or medium confidence is accepted and any other one suggested; without a truth it is the model's.
    """
    kept = mappings.where(F.col("run_id").isNotNull() & (F.trim(F.coalesce("target", F.lit(""))) != ""))
    source = F.when(F.coalesce("source", F.lit("")) != "", F.col("source"))
    score = F.when(F.col("band") == "high", SCORES["high"]).when(F.col("band") == "medium", SCORES["medium"]).when(F.col("band") == "low", SCORES["low"])
    names = N.prepared(source)["normalized"], N.prepared(F.trim("target"))["normalized"]
    status = F.coalesce("status", F.when(F.col("band").isin("high", "medium"), "accepted").otherwise("suggested"))
    return kept.select("run_id", "pos", "user_id", source.alias("source"), F.when(source.isNotNull(), names[0]).alias("source_name"), F.trim("target").alias("target"), names[1].alias("target_name"), score.alias("confidence"), "reason", status.alias("status"), F.coalesce("truth", F.lit("model_suggestion")).alias("truth"))


def canonical(suggested: DataFrame, fallback: DataFrame) -> DataFrame:
    """run_id, pos, source, target, band, status, truth: a run's mappings as its suggestions say, or as in ``fallback`` if it has none."""
    score = F.col("confidence")
    band = F.when(score.isNull(), "none")
    for name, least in BANDS:
        band = band.when(score >= least, name)
    columns = ["run_id", "pos", "source", "target", "band", "status", "truth"]
    said = suggested.withColumn("band", band.when(score > 0, "low").otherwise("none")).select(*columns)
    return said.unionByName(fallback.join(suggested.select("run_id").distinct(), "run_id", "left_anti").select(*columns))


def confirmed(mappings: DataFrame) -> DataFrame:
    """run_id of runs all of whose mappings have a source and a target, are accepted, and come from more than a model's or a position's guess."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    good = filled("source") & filled("target") & (F.coalesce("status", F.lit("accepted")) == "accepted") & ~F.coalesce("truth", F.lit("deterministic_rule")).isin(UNCONFIRMED)
    return mappings.groupBy("run_id").agg(F.bool_and(good).alias("all")).where("all").select("run_id")


def promotion(asked: DataFrame, runs: DataFrame, suggested: DataFrame, mappings: DataFrame, examples: DataFrame) -> DataFrame:
    """run_id, promoted, reason, quality of each asked run (run_id): what keeps it from being learned from, or how good an example it is.

    In order: no id, no such run, an example already (promoted before), a rejected suggestion, one that waits, no suggestion and mappings that are not confirmed.
    ``runs``: run_id, warnings (how many); ``examples``: run_id. Quality is the mean score of the bands less 0.08 for each warning, 0.35 at most.
    """
    states = LE.review_state(suggested).select("run_id", "state")
    mark = lambda df, name: df.select("run_id").distinct().withColumn(name, F.lit(True))
    bands = mappings.groupBy("run_id").agg(F.avg(V.band_score(F.col("band"))).alias("mean"))
    whole = asked.select("run_id").distinct().join(runs, "run_id", "left").withColumn("known", F.col("warnings").isNotNull())
    whole = whole.join(mark(examples, "again"), "run_id", "left").join(states, "run_id", "left").join(mark(confirmed(mappings), "sure"), "run_id", "left").join(bands, "run_id", "left")
    reason = (
        F.when(F.col("run_id").isNull(), "missing_generation_id").when(~F.col("known"), "generation_not_found").when(F.col("again"), "already_promoted")
        .when(F.col("state").isin("has_rejected_suggestions", "has_pending_suggestions"), F.col("state")).when(F.col("state").isNull() & F.col("sure").isNull(), "generation_not_confirmed")
    )
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("mean", F.lit(0.0)) - F.least(0.08 * F.col("warnings"), F.lit(0.35))))
    told = whole.withColumn("reason", reason)
    done = F.col("reason").isNull()
    return told.select("run_id", (done | (F.col("reason") == "already_promoted")).alias("promoted"), "reason", F.when(done, F.round(quality, 6)).alias("quality"))


def learned(promoted: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What newly promoted runs leave: memory entries (run_id, source, target, truth) of their accepted mappings, and dataset candidates (run_id, quality, status, split)."""
    new = promoted.where("promoted and reason is null")
    kept = mappings.where("source is not null and target is not null and coalesce(status, 'accepted') = 'accepted'").join(new.select("run_id"), "run_id", "left_semi")
    entries = kept.select("run_id", "source", "target", F.lit("accepted_generation").alias("truth")).distinct()
    good = new.where(F.col("quality") >= LEAST_QUALITY)
    items = good.select("run_id", "quality", F.when(F.col("quality") >= 0.92, "approved").otherwise("candidate").alias("status"), F.when(F.col("quality") >= 0.85, "train").otherwise("validation").alias("split"))
    return entries, items


def state_hash(mappings: DataFrame) -> DataFrame:
    """run_id, state: the SHA-256 of a run's mappings in order, as JSON."""
    one = F.struct("pos", "source", "target", "band", "status", "truth")
    return mappings.groupBy("run_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}), 256).alias("state"))


def refreshed(versions: DataFrame, mappings: DataFrame) -> DataFrame:
    """run_id, version, parent, state, updated: the versions (run_id, version, state) that runs have after their mappings were read again.

    A new version, one above the last and with it as parent, is added only where the mappings have changed; a run without mappings keeps its last.
    """
    last = versions.groupBy("run_id").agg(F.max_by(F.struct("version", "state"), "version").alias("v"))
    both = last.join(state_hash(mappings), "run_id", "left")
    changed = F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("v.state"))
    return both.select("run_id", F.when(changed, F.col("v.version") + 1).otherwise(F.col("v.version")).alias("version"), F.when(changed, F.col("v.version")).alias("parent"), F.when(changed, F.col("state")).otherwise(F.col("v.state")).alias("state"), changed.alias("updated"))


def patched(versions: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed repairs (run_id, field, value): the corrections they are (value_fix, accepted), and a new version of each repaired run. Blank fields go; of equal fields the last by pos counts."""
    named = patches.withColumn("field", F.trim("field")).where("field <> ''")
    fixes = named.groupBy("run_id", "field").agg(F.max_by("value", "pos").alias("value"))
    fixes = fixes.join(versions.select("run_id").distinct(), "run_id", "left_semi").select("run_id", F.lit("value_fix").alias("kind"), "field", "value", F.lit(True).alias("accepted"))
    last = versions.groupBy("run_id").agg(F.max("version").alias("parent")).join(fixes.select("run_id").distinct(), "run_id", "left_semi")
    return fixes, last.select("run_id", (F.col("parent") + 1).alias("version"), "parent")
