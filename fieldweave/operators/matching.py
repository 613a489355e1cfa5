"""Matching source columns to target fields: rules, scored candidates, one-to-one assignment per case."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldweave.functions import lexicon as L
from fieldweave.functions import names as N
from fieldweave.functions import values as V

FLOOR, SHORTLIST, CONFLICT_WEIGHT = 0.16, 5, 0.3


@F.pandas_udf(DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity 2M/T; there is no built-in that equals it. Called on distinct pairs of names only."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)])


def pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source with every target of its case, both prepared once; a case has few columns, so this is not a cross join of tables: sources (case_id, source_pos, source, sample), targets (case_id, target_pos, target, type)."""
    s = sources.withColumn("s", N.prepared(F.col("source")))
    t = targets.withColumn("t", N.prepared(F.col("target")))
    return s.join(t, "case_id")


def _alias(s: Column, t: Column, one: dict) -> Column:
    """Whether one of the alias rules holds for a pair of prepared names."""
    words = lambda x: F.array(*[F.lit(w) for w in x])
    every = lambda have, x: F.size(F.array_except(words(x), have)) == 0
    some = lambda have, x: F.arrays_overlap(have, words(x))
    sides = {"target_words": (every, t["tokens"]), "target_means": (every, t["canonical"]), "source_means": (every, s["canonical"]), "source_any": (some, s["tokens"]), "source_any_too": (some, s["tokens"])}
    out = F.lit(True)
    for key, (test, have) in sides.items():
        out = out & test(have, one[key]) if key in one else out
    for key, have in (("target_without", t["tokens"]), ("target_not", t["canonical"]), ("source_without", s["tokens"]), ("source_not", s["canonical"])):
        out = out & ~some(have, one[key]) if key in one else out
    return out & (~F.array_contains(t["canonical"], "deal") | F.array_contains(s["canonical"], "deal")) if one.get("deal") else out


def rule(s: Column, t: Column) -> Column:
    """Rank, name and band of the first deterministic rule that matches a pair of prepared names; NULL if none.

    Equal names, alias rules in their order, equal meanings in order, as sets, then a shared domain word with the rest of the target in the source.
    """
    same_set = (F.size(F.array_except(s["canonical"], t["canonical"])) == 0) & (F.size(F.array_except(t["canonical"], s["canonical"])) == 0)
    shared = F.filter(F.array_intersect(s["canonical"], t["canonical"]), lambda w: w.isin(L.PATTERN_WORDS))
    without = lambda x, w: F.filter(x, lambda y: y != w)
    domain = F.exists(shared, lambda w: F.size(F.array_except(without(t["canonical"], w), without(s["canonical"], w))) == 0)
    named = lambda rank, name, band: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(band).alias("band"))
    filled = (F.size(s["canonical"]) > 0) & (F.size(t["canonical"]) > 0)
    out = F.when(filled & (s["normalized"] == t["normalized"]), named(1, "normalized_equal", "high"))
    rank = 1
    for one in L.ALIAS_RULES:
        rank += 0 if one.get("same") else 1
        out = out.when(_alias(s, t, one), named(rank, one["reason"], one["band"]))
    return (
        out.when(filled & (s["canonical"] == t["canonical"]), named(30, "canonical_equal", "high"))
        .when(filled & same_set & (F.size(s["canonical"]) == F.size(t["canonical"])), named(31, "canonical_set_equal", "high"))
        .when(filled & domain, named(32, "domain_pattern", "medium"))
    )


def near_exact(s: Column, t: Column, similar: Column) -> Column:
    """The last rule: nearly equal meanings and spelling, stronger or weaker; NULL if neither."""
    overlap = N.jaccard(s["canonical"], t["canonical"])
    named = lambda rank, band: F.struct(F.lit(rank).alias("rank"), F.lit("near_exact").alias("name"), F.lit(band).alias("band"))
    return F.when((overlap >= 0.999) & (similar >= 0.8), named(33, "high")).when((overlap >= 0.75) & (similar >= 0.88), named(34, "medium"))


def ruled(pair: DataFrame) -> DataFrame:
    """``pair`` with the rule that matches; similarity of spelling is asked only of distinct pairs that no other rule matches and whose meanings overlap enough."""
    known = pair.withColumn("rule", rule(F.col("s"), F.col("t")))
    near = F.col("rule").isNull() & (N.jaccard(F.col("s.canonical"), F.col("t.canonical")) >= 0.75)
    asked = known.where(near).select(F.col("s.canonical_name").alias("a"), F.col("t.canonical_name").alias("b")).distinct().withColumn("similar", ratio("a", "b"))
    both = known.join(asked, (F.col("s.canonical_name") == F.col("a")) & (F.col("t.canonical_name") == F.col("b")), "left").drop("a", "b")
    return both.withColumn("rule", F.coalesce("rule", near_exact(F.col("s"), F.col("t"), F.col("similar")))).drop("similar").where("rule is not null")


def with_positions(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """case_id, target, source, band, reason of every target; ``targets``: case_id, target_pos, target, with source, band and reason of its match or NULL.

    In cases of as many sources as targets of which nothing is matched the k-th target gets the k-th source. In all others a target keeps its match or stays without.
    """
    case = Window.partitionBy("case_id")
    s = sources.select("case_id", F.col("source").alias("_placed"), F.row_number().over(case.orderBy("source_pos", "source")).alias("_k"), F.count(F.lit(1)).over(case).alias("_n"))
    t = targets.withColumns({"_k": F.row_number().over(case.orderBy("target_pos", "target")), "_m": F.count(F.lit(1)).over(case), "_matched": F.count("source").over(case)})
    placed = F.coalesce((F.col("_n") == F.col("_m")) & (F.col("_matched") == 0), F.lit(False))
    pick = lambda fallback, own: F.when(placed, fallback).otherwise(own)
    own = lambda c, none: F.when(F.col("source").isNull(), none).otherwise(F.col(c))
    return t.join(s, ["case_id", "_k"], "left").select(
        "case_id", "target", pick(F.col("_placed"), F.col("source")).alias("source"), pick(F.lit("low"), own("band", "none")).alias("band"), pick(F.lit("position_fallback"), own("reason", "not_found")).alias("reason")
    )


def by_position(sources: DataFrame, targets: DataFrame, matched: DataFrame) -> DataFrame:
    """case_id, target, source, band: in cases of as many sources as targets of which nothing is ``matched`` (case_id), the k-th target gets the k-th source."""
    none = F.lit(None).cast("string")
    marked = targets.join(matched.select("case_id", F.lit("").alias("source")).distinct(), "case_id", "left").withColumns({"band": none, "reason": none})
    return with_positions(sources, marked).where("reason = 'position_fallback'")


def final_confidence(model: Column, prior: Column, conflict: Column) -> Column:
    """A model's confidence with its candidate's score and conflict; without a candidate as it is. Within 0 and 1."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when(prior.isNull(), unit(model)).otherwise(unit(0.72 * unit(model) + 0.28 * unit(prior) - 0.25 * unit(F.coalesce(conflict, F.lit(0.0)))))


def gate(source: Column, used: Column, conflict: Column, band: Column, final: Column) -> Column:
    """Why a model's choice is refused, the first reason that applies; NULL where it is taken (0.68 or more without a conflict)."""
    return (
        F.when(source.isNull() | (F.trim(source) == ""), "model_returned_no_candidate")
        .when(used, "source_already_used")
        .when(conflict.isNotNull() & (conflict != ""), conflict)
        .when((final < 0.68) & (band == "low"), "low_final_confidence")
        .when(final < 0.68, "below_acceptance_threshold")
    )


def routed(mappings: DataFrame) -> DataFrame:
    """Mappings (source, tier, band, score, file_type, mode, prefer_table, weak_form) with band and score lowered where a PDF's form zones are weak."""
    applies = (F.lower("file_type") == "pdf") & (F.col("mode") == "form_layout_mode") & F.col("source").isNotNull() & ~F.col("tier").isin("position_fallback", "unresolved")
    penalty = F.when(applies & F.col("prefer_table"), 0.22).when(applies & F.col("weak_form"), 0.12).otherwise(0.0)
    band = F.col("band")
    lower = F.when(penalty == 0.22, F.when(band.isin("high", "medium"), "low").otherwise(band)).when(penalty == 0.12, F.when(band == "high", "medium").when(band == "medium", "low").otherwise(band)).otherwise(band)
    score = F.when(penalty > 0, F.least(F.greatest(F.col("score") - penalty, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("score"))
    return mappings.withColumn("new_band", lower).withColumn("new_score", score).withColumn("penalty", penalty)


def type_similarity(s: Column, t: Column, wanted: Column, sample: Column) -> Column:
    seen = V.value_type(sample)
    has = lambda x, h: F.array_contains(x["hints"], h)
    return (
        F.when(wanted == "number", F.when(seen == "number", 1.0).when(has(s, "number"), 0.8).otherwise(0.0))
        .when(wanted == "boolean", F.when(seen == "boolean", 1.0).when(has(s, "boolean"), 0.8).otherwise(0.0))
        .when(has(t, "date"), F.when(seen == "date", 1.0).when(has(s, "date"), 0.85).otherwise(0.0))
        .when(has(t, "id") & has(s, "id"), 0.9)
        .when(wanted == "string", F.when(has(s, "string"), 0.5).when(seen == "string", 0.35).otherwise(0.0))
        .otherwise(0.0)
    )


def alignment(s: Column, t: Column) -> Column:
    both = F.array_intersect(s["canonical"], t["canonical"])
    score = 0.35 * F.size(F.filter(both, lambda w: w.isin(L.ALIGNED))) + 0.25 * F.size(F.filter(both, lambda w: w.isin("created", "updated")))
    return F.least(score, F.lit(1.0))


def base_score(s: Column, t: Column, wanted: Column, sample: Column, hint: Column) -> Column:
    """The score of a candidate but for the similarity of spelling."""
    domains = lambda x: F.filter(x["canonical"], lambda w: w.isin(L.SCORED_DOMAINS))
    return (
        0.34 * N.jaccard(s["canonical"], t["canonical"])
        + 0.1 * N.jaccard(s["tokens"], t["tokens"])
        + 0.12 * N.jaccard(domains(s), domains(t))
        + 0.12 * type_similarity(s, t, wanted, sample)
        + 0.1 * alignment(s, t)
        + 0.12 * F.greatest(F.least(hint, F.lit(1.0)), F.lit(0.0))
        - CONFLICT_WEIGHT * N.conflict(s["canonical"], t["canonical"], L.CONFLICTS)
    )


def scored(pair: DataFrame) -> DataFrame:
    """case_id, target, source, score of all candidates at the floor or above, ranked within their target."""
    distinct = pair.select(F.col("s.canonical_name").alias("a"), F.col("t.canonical_name").alias("b")).distinct().withColumn("similar", ratio("a", "b"))
    full = pair.join(distinct, (F.col("s.canonical_name") == F.col("a")) & (F.col("t.canonical_name") == F.col("b")))
    score = base_score(F.col("s"), F.col("t"), F.col("type"), F.col("sample"), F.lit(0.0)) + 0.22 * F.col("similar")
    full = full.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).where(F.col("score") >= FLOOR)
    best = Window.partitionBy("case_id", "target_pos").orderBy(F.col("score").desc(), "source_pos")
    return full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SHORTLIST).select("case_id", "target_pos", "target", "source_pos", "source", "score", "rank")


def assigned(pair: DataFrame) -> DataFrame:
    """One-to-one mapping per case: targets in order, each takes the first source of its best rule that is still free.

    What one target takes the next cannot, so each case is folded in order; only pairs that match a rule reach the fold, and
    cases are the parallel axis.
    """
    chosen = ruled(pair).select("case_id", "target_pos", "target", "source_pos", "source", "rule.rank", "rule.name", "rule.band")

    def fold(case: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, options in case.sort_values(["target_pos", "rank", "source_pos"]).groupby("target_pos", sort=True):
            free = options[~options["source_pos"].isin(used)]
            if len(free):
                used.add(free.iloc[0]["source_pos"])
                out.append(free.iloc[0])
        return pd.DataFrame(out, columns=case.columns)[["case_id", "target", "source", "name", "band"]]

    return chosen.groupBy("case_id").applyInPandas(fold, "case_id long, target string, source string, name string, band string")
