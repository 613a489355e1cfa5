"""Registered queries of runs and their states. Imported by ``queries`` last, whose registry it fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.operators import run_state as RS
from fieldweave.plans.queries import query


def mappings(table):
    """A customer's orders as runs and their lines as mappings; some without a source, a target, a status or a truth."""
    line = table("lineitem")
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.select(
        F.col("l_orderkey").alias("run_id"), pos.alias("pos"), (F.col("l_suppkey") % 50).alias("user_id"), F.when(F.col("l_linenumber") != 4, F.concat(F.lit("order Part"), (F.col("l_partkey") % 9).cast("string"))).alias("source"), F.when(F.col("l_linenumber") == 6, " ").otherwise(F.concat(F.lit(" target_"), F.col("l_linenumber").cast("string"))).alias("target"),
        F.when(F.col("l_quantity") > 30, "high").when(F.col("l_quantity") > 10, "medium").when(F.col("l_quantity") > 5, "low").otherwise("none").alias("band"), F.lit("rule").alias("reason"),
        F.when(F.col("l_extendedprice") < 3000, "rejected").when(F.col("l_linestatus") == "O", "accepted").alias("status"), F.when(F.col("l_returnflag") != "N", "deterministic_rule").alias("truth"),
    )


def runs(table):
    """Orders as runs; those of low priority have not been suggested to anyone, and urgent ones are examples already."""
    o = table("orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 4).alias("warnings"), "o_orderpriority")
    given = mappings(table).join(o.where("o_orderpriority <> '5-LOW'").select("run_id"), "run_id", "left_semi")
    suggested = RS.suggestions(given)
    return o, suggested, RS.canonical(suggested, mappings(table).where("trim(target) <> ''"))


@query
def m30_suggestions(table):
    return RS.suggestions(mappings(table)).select("run_id", F.col("pos.l_linenumber").alias("line"), "user_id", "source", "source_name", "target", "target_name", "confidence", "status", "truth")


def _promoted(table):
    o, suggested, canonical = runs(table)
    asked = o.select("run_id").unionByName(table("customer").select((-F.col("c_custkey") - 1).alias("run_id"))).unionByName(table("region").select(F.lit(None).cast("long").alias("run_id")))
    return RS.promotion(asked, o.select("run_id", "warnings"), suggested, canonical, o.where("o_orderpriority = '1-URGENT'")), canonical


@query
def m31_promotion(table):
    return _promoted(table)[0]


@query
def m31_learned(table):
    """What promoted runs leave in memory and in the dataset, by truth and by split."""
    entries, items = RS.learned(*_promoted(table))
    left = entries.groupBy(F.col("truth").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))
    return left.unionByName(items.groupBy(F.concat_ws(" ", "status", "split").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs")))


@query
def m45_versions(table):
    """Runs whose mappings are read again: those of finished orders have changed since, those of open ones have not."""
    o, _, canonical = runs(table)
    state = RS.state_hash(canonical)
    versions = table("orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5 + 1).alias("version"), "o_orderstatus").join(state, "run_id", "left")
    versions = versions.withColumn("state", F.when(F.col("o_orderstatus") == "F", F.lit("before")).otherwise(F.col("state"))).drop("o_orderstatus")
    return RS.refreshed(versions, canonical).select("run_id", "version", "parent", "updated")


@query
def m46_patches(table):
    """Reviewed repairs of orders, by the priorities of a customer's other orders."""
    versions = table("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("version"))
    patches = table("orders").select((F.col("o_custkey") + F.when(F.col("o_orderstatus") == "P", 1_000_000).otherwise(0)).alias("run_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")).alias("field"), F.col("o_orderstatus").alias("value"))
    fixes, after = RS.patched(versions, patches)
    return after.join(fixes.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", "value"))), ",").alias("fixes")), "run_id")
