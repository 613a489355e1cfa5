"""How far a form's reading can be relied on: which source its zones call for, and what needs a second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# From which confidence on a zone counts, how much surer a table must be than a form, and kinds of zones.
SURE_TABLE, SURE_FORM, SURER = 0.7, 0.65, 0.05
ZONES = ["table", "form", "text", "noise"]


def routing(files: DataFrame, zones: DataFrame, table: float = SURE_TABLE, form: float = SURE_FORM) -> DataFrame:
    """doc_id, has_ and best_ of each kind of zone, low_form and prefer_table of the PDF files (doc_id, file_type, columns, rows: how many).

    ``zones``: doc_id, zone, confidence (null: not told). A table is preferred if it is sure, surer than the form by SURER, and has columns and rows.
    """
    best = zones.where("confidence is not null").groupBy("doc_id").agg(*[F.max(F.when(F.col("zone") == z, F.col("confidence"))).alias(f"best_{z}") for z in ZONES])
    told = files.where(F.lower("file_type") == "pdf").join(best, "doc_id", "left")
    sure = lambda z, least: F.coalesce(F.col(f"best_{z}") >= least, F.lit(False))
    surer = F.col("best_form").isNull() | (F.col("best_table") > F.col("best_form") + SURER)
    return told.select(
        "doc_id", *[F.col(f"best_{z}").isNotNull().alias(f"has_{z}") for z in ZONES], *[f"best_{z}" for z in ZONES],
        (F.col("best_form").isNotNull() & ~sure("form", form)).alias("low_form"), (sure("table", table) & (F.col("columns") > 0) & (F.col("rows") > 0) & surer).alias("prefer_table"),
    )


def _flag(when: Column, code: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(code))


def assessed(forms: DataFrame, fields: DataFrame, groups: DataFrame, routed: DataFrame) -> DataFrame:
    """doc_id, counts, fields and groups to look at, ``flags`` in order, needs_attention and repair_recommended of each form (doc_id, mode, targets, resolved: how many).

    ``fields``: doc_id, field, status, resolved_by, critical; ``groups``: doc_id, group_id, group_type, options (with selected); ``routed`` as of ``routing``.
    """
    named = lambda when, name: F.array_sort(F.collect_list(F.when(when, F.col("field")))).alias(name)
    status, by = F.col("status"), F.col("resolved_by")
    told = fields.groupBy("doc_id").agg(named(status == "ambiguous", "ambiguous"), named(status == "not_found", "unresolved"), named(by == "repair_model", "repaired"), named(by == "fallback_blocked", "blocked"), named(F.col("critical") & ~status.isin("resolved", "weak_match"), "critical"))
    torn = (F.col("group_type") == "single_choice") & (F.size(F.filter("options", lambda o: o["selected"])) > 1)
    split = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"), F.array_sort(F.collect_list(F.when(torn, F.col("group_id")))).alias("torn"))
    whole = forms.join(told, "doc_id", "left").join(split, "doc_id", "left").join(routed.select("doc_id", "prefer_table", "has_form", "low_form"), "doc_id", "left")
    some = lambda c: F.size(c) > 0
    few = (F.col("targets") >= 3) & (F.col("resolved") <= F.greatest(F.floor(F.col("targets") / 3), F.lit(1)))
    prefer = F.coalesce("prefer_table", F.lit(False))
    flags = F.array_compact(F.array(
        _flag(some("critical"), "critical_unresolved"), _flag(some("ambiguous"), "ambiguous_fields"), _flag(some("torn"), "single_choice_multi_select"), _flag(F.col("mode") == "legacy_fallback", "legacy_fallback_used"),
        _flag((F.col("resolved") == 0) & (F.col("targets") > 0), "empty_normalized_row"), _flag(few, "low_field_coverage"), _flag(prefer, "pdf_zone_prefers_table"), _flag(~prefer & F.col("has_form") & F.col("low_form"), "low_confidence_form_zones"),
    ))
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("ambiguous", "unresolved", "repaired", "blocked", "critical", "torn")}
    told = whole.withColumn("flags", flags).withColumns(lists).withColumn("groups", F.coalesce("groups", F.lit(0).cast("long")))
    return told.withColumns({"needs_attention": some("flags"), "repair_recommended": some("flags") & (F.col("mode") != "repair_model")}).drop("prefer_table", "has_form", "low_form")
