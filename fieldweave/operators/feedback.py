"""Feedback analytics as views over an append-only correction log.

Everything the log implies (memory, pattern statistics, promotion, graph edges, event feed) is an aggregation of it, so there is
no table to update in place and batch and stream run the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import lexicon as L
from fieldweave.functions import names as N

def memory(log: DataFrame) -> DataFrame:
    """Personal memory per (user, source, target): uses, outcomes, last decision, mean confidence, weight of accepted uses.

    Confidences are summed in the order of the log (event_id), by running sums over sorted rows: what rounding leaves decides between equal
    scores, and must not depend on how rows were dealt to tasks.
    """
    pair = ["user_id", "source", "target"]
    so_far = Window.partitionBy(*pair).orderBy("event_id", "ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.when(F.col("accepted"), F.greatest("confidence", F.lit(0.2)))
    told = log.select(*pair, "ts", "event_id", "accepted", "confidence", F.row_number().over(so_far).alias("_n"), F.sum("confidence").over(so_far).alias("_confidence"), F.sum(weight).over(so_far).alias("_weight"))
    return told.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.count_if("accepted").alias("success_count"),
        F.count_if(~F.col("accepted")).alias("failure_count"),
        F.max_by("accepted", F.struct("ts", "event_id")).alias("last_accepted"),
        F.try_divide(F.max_by("_confidence", "_n"), F.count("confidence")).alias("mean_confidence"),
        F.coalesce(F.max_by("_weight", "_n"), F.lit(0.0)).alias("weight"),
    )


def memory_score(confidence: Column, success: Column, failure: Column, uses: Column, same_schema: Column) -> Column:
    """How much a remembered mapping counts as a candidate: confidence, success rate, use, same schema; at most 1."""
    rate = success / F.greatest(success + failure, F.lit(1))
    return F.least(F.lit(1.0), 0.55 * F.coalesce(confidence, F.lit(0.55)) * 1.0 + 0.25 * rate + 0.1 * F.least(uses / 4, F.lit(1.0)) + 0.1 * same_schema)


def shared_score(confidence: Column, stability: Column, support: Column, users: Column, same_schema: Column) -> Column:
    return F.least(
        F.lit(1.0),
        0.35 * F.coalesce(confidence, F.lit(0.55)) + 0.35 * F.coalesce(stability, F.lit(0.0)) + 0.2 * F.least(support / 5, F.lit(1.0)) + 0.1 * F.least(users / 3, F.lit(1.0)) + 0.1 * same_schema,
    )


ID_LIKE = r"^(?=.*[A-Za-zА-Яа-я])(?=.*\d)[A-Za-zА-Яа-я0-9_-]{6,}$"


def sensitivity(label: Column, name: Column, rare: Column) -> Column:
    """Risk that a label names private matters, at most 1: patterns of the label, listed, code-like, id-like and rare tokens, mixed or single long ones.

    ``name`` is the prepared label, ``rare`` the number of its tokens that at most one user has.
    """
    tokens = name["tokens"]
    count = lambda p: F.size(F.filter(tokens, p))
    score = (
        F.when(label.rlike(r"(?i)[\w.+-]+@[\w-]+\.[\w.-]+"), 1.0).otherwise(0.0)
        + F.when(label.rlike(r"\+?\d[\d\-\s()]{8,}\d"), 1.0).otherwise(0.0)
        + F.when(label.rlike(r"(?i)https?://|www\."), 0.7).otherwise(0.0)
        + 0.8 * count(lambda t: t.isin(L.SENSITIVE))
        + 0.5 * count(lambda t: t.rlike(r"^[0-9_-]{4,}$"))  # capitals and digits; tokens are lower-case, so digits
        + 0.8 * count(lambda t: t.rlike(ID_LIKE))
        + 0.25 * rare
        + F.when(name["normalized"].rlike("[0-9]") & name["normalized"].rlike(r"\p{L}"), 0.3).otherwise(0.0)
        + F.when((F.size(name["canonical"]) == 1) & (F.length(F.get(name["canonical"], F.lit(0))) >= 12), 0.25).otherwise(0.0)
    )
    return F.least(F.round(score, 4), F.lit(1.0))


def rare_tokens(log: DataFrame) -> DataFrame:
    """token: canonical words of eight letters or more, none of the general ones, that at most one user's labels hold."""
    labels = log.select("user_id", "source").distinct()
    words = labels.select("user_id", F.explode(F.array_distinct(N.prepared(F.col("source"))["canonical"])).alias("token"))
    words = words.where((F.length("token") >= 8) & ~F.col("token").isin([*L.DOMAIN_TAGS, "boolean"]))
    return words.groupBy("token").agg(F.count_distinct("user_id").alias("users")).where("users <= 1").select("token")


def cleaned(canonical: Column) -> Column:
    """A name's canonical tokens without listed, private-looking, id-like and numeric ones."""
    return F.filter(canonical, lambda w: ~w.isin(L.SENSITIVE) & ~w.rlike(ID_LIKE) & ~w.rlike("^[0-9]+$"))


def generality(canonical: Column, cluster: Column, role: Column) -> Column:
    """How far a pattern can hold beyond one user: brevity, a concept, a role, up to three domain tags."""
    n = F.size(canonical)
    tags = F.size(F.array_distinct(F.filter(canonical, lambda w: w.isin(L.DOMAIN_TAGS))))
    score = 0.2 + F.when(n <= 5, 0.2).otherwise(0.0) + F.when(cluster.isNotNull(), 0.25).otherwise(0.0) + F.when(role.isNotNull(), 0.15).otherwise(0.0) + 0.08 * F.least(tags, F.lit(3))
    return F.when(n == 0, 0.0).otherwise(F.least(F.round(score, 4), F.lit(1.0)))


def concept(source: Column, target: Column) -> Column:
    """The concept of a pair of prepared names: the first that applies; NULL if none."""
    both = F.array_union(target["canonical"], source["canonical"])
    has = lambda *w: F.forall(F.array(*[F.lit(x) for x in w]), lambda x: F.array_contains(both, x))
    rules = [
        (("created", "date"), "temporal.creation"),
        (("updated", "date"), "temporal.update"),
        (("id",), "identity.identifier"),
        (("revenue",), "finance.revenue"),
        (("amount", "gross"), "finance.amount.gross"),
        (("amount", "net"), "finance.amount.net"),
        (("amount",), "finance.amount"),
        (("quantity",), "inventory.quantity"),
        (("organization",), "entity.organization"),
        (("customer",), "entity.customer"),
        (("product",), "entity.product"),
        (("name",), "identity.name"),
        (("description",), "text.description"),
        (("creator",), "ownership.creator"),
        (("responsible",), "ownership.responsible"),
        (("source",), "channel.source"),
        (("partner",), "entity.partner"),
    ]
    out = F.lit(None).cast("string")
    for words, name in reversed(rules):
        out = F.when(has(*words), name).otherwise(out)
    return out


def pattern_stats(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Statistics of every (source, target) over all users (and of each value of ``by``), and the features that promotion asks for.

    Names are prepared once per pair after the aggregation, not once per correction.
    """
    stats = log.groupBy(*by, "source", "target").agg(
        F.count(F.lit(1)).alias("support"),
        F.count_distinct("user_id").alias("users"),
        F.count_if("accepted").alias("accepts"),
        F.count_if(~F.col("accepted")).alias("rejects"),
        F.avg("confidence").alias("mean_confidence"),
    )
    named = stats.withColumn("s", N.prepared(F.col("source"))).withColumn("t", N.prepared(F.col("target")))
    rate = F.col("accepts") / (F.col("accepts") + F.col("rejects"))
    named = named.withColumn("acceptance", rate).withColumn("drift", 1 - rate).withColumn("conflict", N.pattern_conflict(F.col("s.canonical"), F.col("t.canonical")))
    named = named.withColumn("role", N.role_of_pair(F.col("s"), F.col("t"))).withColumn("concept", concept(F.col("s"), F.col("t")))
    held = stats.select("source").distinct().select("source", F.explode(F.array_distinct(N.prepared(F.col("source"))["canonical"])).alias("token"))
    rare = held.join(rare_tokens(log), "token", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("rare"))
    named = named.join(rare, "source", "left").withColumn("sensitivity", sensitivity(F.col("source"), F.col("s"), F.coalesce("rare", F.lit(0)))).drop("rare")
    return named.withColumn("generality", generality(cleaned(F.col("s.canonical")), F.col("concept"), F.col("role"))).drop("s", "t")


def promotion(stats: DataFrame) -> DataFrame:
    """Status and reason of each pattern: ordered gates, the first that applies."""
    c = F.col
    gates = [
        (c("sensitivity") >= L.MAX_SENSITIVITY, "blocked_sensitive", "sensitive_context"),
        (c("generality") < L.MIN_GENERALITY, "personal_only", "not_generalizable"),
        ((c("accepts") < 2) | (c("support") < 2), "personal_only", "insufficient_accepts"),
        (c("accepts") < L.MIN_SUPPORT, "shared_candidate", "insufficient_accepts"),
        (c("users") < L.MIN_USERS, "shared_candidate", "insufficient_cross_user_support"),
        (c("acceptance") < L.MIN_ACCEPTANCE, "shared_candidate", "low_acceptance_rate"),
        (c("conflict") > L.MAX_CONFLICT, "personal_only", "semantic_instability"),
        (c("drift") > L.MAX_DRIFT, "shared_candidate", "high_drift"),
        (c("mean_confidence") < L.MIN_CONFIDENCE, "shared_candidate", "low_mean_confidence"),
    ]
    return _decided(stats, gates)


def bulk_promotion(stats: DataFrame, support: int = L.MIN_SUPPORT, users: int = L.MIN_USERS, stability: float = L.MIN_STABILITY, drift: float = L.MAX_DRIFT) -> DataFrame:
    """Promotion with thresholds given for the occasion; generality outranks sensitivity here, and both outrank the rest."""
    c = F.col
    enough = (c("support") >= support) & (c("users") >= users) & (c("acceptance") >= stability) & (c("drift") <= drift) & (c("acceptance") >= L.MIN_ACCEPTANCE)
    gates = [
        (c("generality") < L.MIN_GENERALITY, "personal_only", "not_generalizable"),
        (c("sensitivity") >= L.MAX_SENSITIVITY, "blocked_sensitive", "sensitive_context"),
        (c("conflict") > L.MAX_CONFLICT, "personal_only", "semantic_instability"),
        (c("acceptance") < L.MIN_ACCEPTANCE, "shared_candidate", "low_acceptance_rate"),
        (enough, "shared_promoted", "manual_threshold_promotion"),
        ((c("accepts") < 2) | (c("support") < 2), "personal_only", "insufficient_accepts"),
        (c("accepts") < L.MIN_SUPPORT, "shared_candidate", "insufficient_accepts"),
        (c("users") < L.MIN_USERS, "shared_candidate", "insufficient_cross_user_support"),
        (c("drift") > L.MAX_DRIFT, "shared_candidate", "high_drift"),
        (c("mean_confidence") < L.MIN_CONFIDENCE, "shared_candidate", "low_mean_confidence"),
    ]
    return _decided(stats, gates)


def _decided(stats: DataFrame, gates: list[tuple[Column, str, str]]) -> DataFrame:
    verdict = F.struct(F.lit("shared_promoted").alias("status"), F.lit("stable_generalized_pattern").alias("reason"))
    for when, status, reason in reversed(gates):
        verdict = F.when(when, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return stats.withColumn("verdict", verdict).select("*", "verdict.status", "verdict.reason").drop("verdict")


def status_changes(log: DataFrame, every: str = "day") -> DataFrame:
    """A pattern's running acceptance by period, only where its standing (stable or not) changes."""
    daily = log.withColumn("period", F.date_trunc(every, "ts")).groupBy("source", "target", "period").agg(F.count_if("accepted").alias("accepts"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source", "target").orderBy("period")
    rate = F.sum("accepts").over(so_far) / F.sum("n").over(so_far)
    rated = daily.withColumn("acceptance", rate).withColumn("standing", F.when(F.col("acceptance") >= L.MIN_ACCEPTANCE, "stable").otherwise("unstable"))
    before = F.lag("standing").over(so_far)
    return rated.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("standing"))).select("source", "target", "period", "before", "standing", "acceptance")


def event_feed(branches: dict[str, DataFrame], newest: int) -> DataFrame:
    """kind, at, id, title of the newest events: the newest of each branch, merged, newest first."""
    merged = None
    for kind, df in branches.items():
        part = df.select(F.lit(kind).alias("kind"), "at", "id", "title").orderBy(F.col("at").desc(), F.col("id").desc()).limit(newest)
        merged = part if merged is None else merged.unionByName(part)
    return merged.orderBy(F.col("at").desc(), "kind", F.col("id").desc()).limit(newest)
