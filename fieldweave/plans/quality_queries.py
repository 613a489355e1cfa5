"""Registered queries of how far forms can be relied on. Imported by ``queries`` last, whose registry it fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.operators import form_model as FM
from fieldweave.operators import form_quality as FQ
from fieldweave.plans.form_queries import form_rows
from fieldweave.plans.queries import query


def _routed(table):
    """Customers as files, their orders as zones."""
    files = table("customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") % 5 == 0, "docx").otherwise("PDF").alias("file_type"), (F.col("c_custkey") % 3).alias("columns"), (F.col("c_custkey") % 4).alias("rows"))
    zone = F.when(F.col("o_orderpriority") == "1-URGENT", "table").when(F.col("o_orderpriority") == "2-HIGH", "form").when(F.col("o_orderpriority") == "3-MEDIUM", "text").otherwise("noise")
    zones = table("orders").select(F.col("o_custkey").alias("doc_id"), zone.alias("zone"), F.when(F.col("o_orderstatus") != "P", F.round(F.least(F.col("o_totalprice") / 400_000, F.lit(1.0)), 3)).alias("confidence"))
    return FQ.routing(files, zones)


@query
def a18_zone_routing(table):
    return _routed(table)


@query
def a19_form_quality(table):
    """The forms of customers: their orders as fields."""
    o = table("orders")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_totalprice") > 250_000, "ambiguous").when(F.col("o_totalprice") > 200_000, "weak_match").otherwise("not_found")
    by = F.when(F.col("o_orderpriority") == "5-LOW", "repair_model").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "fallback_blocked").otherwise("form_resolver")
    fields = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("field"), status.alias("status"), by.alias("resolved_by"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"))
    forms = table("customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_mktsegment") == "BUILDING", "legacy_fallback").when(F.col("c_mktsegment") == "MACHINERY", "repair_model").otherwise("form_resolver").alias("mode"), (F.col("c_custkey") % 7).alias("targets"), (F.col("c_custkey") % 3).alias("resolved"))
    found = FQ.assessed(forms, fields, FM.table_groups(form_rows(table), digits=False), _routed(table))
    return found.select("doc_id", "mode", "targets", "resolved", "groups", *[F.array_join(c, ",").alias(c) for c in ("ambiguous", "unresolved", "repaired", "blocked", "critical", "torn", "flags")], "needs_attention", "repair_recommended")
