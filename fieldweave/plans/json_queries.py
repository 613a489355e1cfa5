"""Registered queries of JSON of unknown shape. Imported by ``queries`` last, whose registry it fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.operators import json_rows as J
from fieldweave.plans.queries import query


def texts(table):
    """An event as JSON of one of five shapes, by its type: an array, an object with rows, a fence in a text, a wrapped list, none."""
    props, value = F.col("props"), F.floor("value").cast("string")
    shapes = {
        "click": F.concat(F.lit('[{"id": 1, "props": '), props, F.lit(', "ok": true}, 5, {"v": "'), value, F.lit('"}]')),
        "view": F.concat(F.lit(' {"rows": [{"v": '), value, F.lit(', "none": null}, null, {"list": [1, 2]}], "more": 1}')),
        "signup": F.concat(F.lit("Here it is:\n```json\n{\"mappings\": [{\"v\": "), value, F.lit("}]}\n``` done")),
        "purchase": F.concat(F.lit('{"DATA ": [{"n": '), value, F.lit('}, {"m": '), props, F.lit("}]}")),
    }
    text = F.lit("so {v: 1} is no JSON but [") .alias("text")
    for kind, shape in shapes.items():
        text = F.when(F.col("event_type") == kind, shape).otherwise(text)
    return table("events").select(F.col("event_id").cast("long").alias("doc_id"), F.concat(text, F.when(F.col("event_type") == "error", F.concat(value, F.lit("] ends"))).otherwise("")).alias("text"))


@query
def sc12_json_rows(table):
    return J.cells(J.json_rows(texts(table)))


@query
def f32_targets(table):
    return J.target_rows(texts(table)).select("doc_id", "root", F.array_join("fields", ",").alias("fields"))


@query
def f29_payloads(table):
    return J.payloads(texts(table))


def files(table):
    """Customers as JSON of parsed files: their orders as pairs and sheets, some fields missing."""
    pair = F.concat(F.lit('{"label": "order", "value": '), F.col("o_orderkey").cast("string"), F.lit(', "confidence": "'), F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "sure").otherwise(""), F.lit('"}'))
    sheet = F.concat(F.lit('{"columns": ["a", 2], "rows": [{"a": '), F.col("o_custkey").cast("string"), F.lit("}, 7]"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(', "name": "s'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(""), F.lit("}"))
    listed = table("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("c")))), lambda x: x["c"]), ", ").alias(n) for n, c in (("pairs", pair), ("sheets", sheet))])
    text = F.concat(F.lit('{"file_name": "f'), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit('", "file_type": "csv')).otherwise(""), F.lit('", "raw_text": null, "columns": ["x", 1], "rows": [{}, 1], "kv_pairs": ['), F.col("pairs"), F.lit(', "no pair"], "sheets": ['), F.col("sheets"), F.lit("]}"))
    return listed.select("doc_id", text.alias("text"))


@query
def sc10_parsed_files(table):
    return J.parsed_files(files(table)).withColumn("columns", F.array_join("columns", ","))


@query
def sc10_file_pairs(table):
    return J.file_pairs(files(table))


@query
def sc10_file_sheets(table):
    return J.file_sheets(files(table)).select("doc_id", "sheet", "name", F.array_join("columns", ",").alias("columns"), F.array_join("rows", ";").alias("rows"))
