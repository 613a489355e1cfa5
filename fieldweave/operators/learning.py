"""Learning state as views of the log of suggestions: counts, layers, lists, look-ups.

Suggestions are (run_id, user_id, ts, source, target, truth, status, confidence); status is accepted, rejected or suggested. Each function is
one aggregation or one equi-join over all users at once; the few newest or best of a user come from a window over that user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import lexicon as L
from fieldweave.functions import names as N
from fieldweave.operators import feedback as FB


def counts(suggestions: DataFrame, memory: DataFrame) -> DataFrame:
    """A user's counts of suggestions, by outcome and for those of the model, the model's acceptance (NULL if nothing was reviewed) and remembered pairs."""
    model, accepted, rejected = F.col("truth") == "model_suggestion", F.col("status") == "accepted", F.col("status") == "rejected"
    n = suggestions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("mapping_suggestions"),
        F.count_if(accepted | rejected).alias("user_corrections"),
        F.count_if(model).alias("model_based"),
        F.count_if(model & accepted).alias("model_accepted"),
        F.count_if(model & rejected).alias("model_rejected"),
        F.count_distinct("run_id").alias("runs"),
    )
    n = n.withColumn("model_acceptance", F.try_divide(F.col("model_accepted"), F.col("model_accepted") + F.col("model_rejected")))
    entries = memory.groupBy("user_id").agg(F.count(F.lit(1)).alias("mapping_memory"))
    return n.join(entries, "user_id", "left").fillna(0, ["mapping_memory"])


def staging_counts(suggestions: DataFrame) -> DataFrame:
    """user_id, pending, rejected, total of what is not accepted."""
    open_ = suggestions.where(F.col("status").isin("suggested", "rejected"))
    return open_.groupBy("user_id").agg(F.count_if(F.col("status") == "suggested").alias("pending"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count(F.lit(1)).alias("total"))


def staging(suggestions: DataFrame, limit: int) -> DataFrame:
    """A user's open pairs with how often and when they were last seen: suggested before rejected, then the newest, ``limit`` a user."""
    open_ = suggestions.where(F.col("status").isin("suggested", "rejected"))
    seen = open_.groupBy("user_id", "source", "target", "truth", "status").agg(F.count(F.lit(1)).alias("seen"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence"), F.max("ts").alias("last_seen"))
    order = [F.when(F.col("status") == "suggested", 0).otherwise(1), F.col("last_seen").desc(), "source", "target", "truth"]
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= limit)


def review_state(suggestions: DataFrame) -> DataFrame:
    """run_id, total, accepted, rejected, pending (suggested with a source) and state.

    A rejected suggestion is looked at first, then one that waits: has_rejected_suggestions, has_pending_suggestions, else confirmed. Runs without
    suggestions have no row.
    """
    n = suggestions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if((F.col("status") == "suggested") & F.col("source").isNotNull()).alias("pending"),
    )
    return n.withColumn("state", F.when(F.col("rejected") > 0, "has_rejected_suggestions").when(F.col("pending") > 0, "has_pending_suggestions").otherwise("confirmed"))


def layers(suggestions: DataFrame, memory: DataFrame, patterns: DataFrame, user_edges: DataFrame) -> DataFrame:
    """user_id (NULL: everyone), layer, kind, n: the counts of the staging, personal, shared and graph layers in one long table."""
    long = lambda df, key, layer, kinds: df.select(key, F.lit(layer).alias("layer"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("n")) for k in kinds])).alias("k")).select(key, "layer", "k.*")
    own = memory.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("success_count").alias("accepted"), F.sum("failure_count").alias("rejected"))
    graph = user_edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("accepts").alias("accepted"), F.sum("rejects").alias("rejected"))
    statuses = ["personal_only", "shared_candidate", "shared_promoted", "blocked_sensitive"]
    shared = patterns.agg(F.count(F.lit(1)).alias("patterns"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses]).withColumn("user_id", F.lit(None).cast("long"))
    out = long(staging_counts(suggestions), "user_id", "staging", ["pending", "rejected", "total"])
    for df, layer, kinds in ((own, "personal", ["entries", "accepted", "rejected"]), (graph, "graph", ["edges", "accepted", "rejected"]), (shared, "shared", ["patterns", *statuses])):
        out = out.unionByName(long(df, "user_id", layer, kinds))
    return out


def remembered(memory: DataFrame, schema: Column, limit: int) -> DataFrame:
    """A user's remembered pairs: the same schema first, then successes, weight and recency, ``limit`` a user."""
    order = [F.col("schema_match").desc(), F.col("success_count").desc(), F.col("weight").desc(), F.col("last_used").desc(), "source", "target"]
    matched = memory.withColumn("schema_match", F.when(schema, 1).otherwise(0))
    return matched.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= limit)


def shared_lookup(patterns: DataFrame, asked: DataFrame, candidates: bool, limit: int, schema: Column | None = None) -> DataFrame:
    """Promoted (and, if ``candidates``, candidate) patterns for asked pairs (source, target): those of the same ``schema`` first, then by status, stability, support and users, ``limit`` a source."""
    allowed = ["shared_promoted", "shared_candidate"] if candidates else ["shared_promoted"]
    found = patterns.where(F.col("status").isin(allowed)).join(asked.select("source", "target").distinct(), ["source", "target"], "left_semi")
    order = [F.when(F.lit(False) if schema is None else F.coalesce(schema, F.lit(False)), 1).otherwise(0).desc(), F.when(F.col("status") == "shared_promoted", 3).otherwise(2).desc(), F.col("acceptance").desc(), F.col("support").desc(), F.col("users").desc(), "target"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("rank") <= limit)


def promotable(patterns: DataFrame, support: int, users: int, stability: float, drift: float) -> DataFrame:
    """Shared patterns that pass the four thresholds."""
    c = F.col
    return patterns.where(c("status").isin("shared_candidate", "shared_promoted") & (c("support") >= support) & (c("users") >= users) & (c("acceptance") >= stability) & (c("drift") <= drift))


def active_tokens(registry: DataFrame) -> DataFrame:
    """user_id and token of the registry (token, scope, user_id, active): active tokens of everyone (NULL) and of each user."""
    live = registry.where(F.col("active") & F.col("scope").isin("global", "user") & (F.trim("token") != ""))
    return live.select(F.when(F.col("scope") == "user", F.col("user_id")).alias("user_id"), F.lower(F.trim("token")).alias("token")).distinct()


def run_counts(users: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """``key`` and runs of all users, those without any included."""
    n = runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"))
    return users.select(key).join(n, key, "left").fillna(0, ["runs"])


def normal_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (label, field) with their cleaned source, target, role, concept, domain tags and the hash of the first four. Names are prepared once."""
    s, t = F.col("s"), F.col("t")
    named = pairs.withColumn("s", N.prepared(F.col("label"))).withColumn("t", N.prepared(F.col("field")))
    named = named.withColumn("source", F.coalesce(F.nullif(F.array_join(FB.cleaned(s["canonical"]), " "), F.lit("")), s["normalized"])).withColumn("target", t["normalized"])
    named = named.withColumn("role", N.role_of_pair(s, t)).withColumn("concept", FB.concept(s, t))
    tags = F.array_sort(F.array_distinct(F.filter(F.concat(s["canonical"], t["canonical"]), lambda w: w.isin(L.DOMAIN_TAGS))))
    mark = F.sha2(F.concat_ws("|", "source", "target", F.coalesce("role", F.lit("")), F.coalesce("concept", F.lit(""))), 256)
    return named.withColumn("tags", F.array_join(tags, ",")).withColumn("hash", mark).drop("s", "t")


def picked(candidates: DataFrame, least: float) -> DataFrame:
    """The best candidate (case_id, target, source, score, confidence, used) of each target that is free and scores ``least`` or more."""
    free = candidates.where(~F.col("used") & F.col("source").isNotNull() & (F.col("score") >= least))
    best = free.groupBy("case_id", "target").agg(F.max_by(F.struct("source", "score"), F.struct("score", "confidence", F.col("source").alias("s"))).alias("b"))
    return best.select("case_id", "target", "b.source", "b.score")
