"""Rows and tables out of JSON of any shape, as VARIANT: no schema is known or inferred, so one odd document costs the others nothing.

Text that is no JSON gives NULL, as does an object that names a key twice: it does not say which of the values is meant.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of an object that only wraps a list, and where a model puts JSON in a text.
WRAPPERS = ["input", "items", "rows", "data"]
FENCE = r"```(?:json)?\s*(.*?)```"
KINDS = ["high", "medium", "low"]


def parsed(text: Column) -> Column:
    """The VARIANT of a JSON text; NULL for anything else."""
    return F.try_parse_json(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", "")))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def as_list(value: Column, path: str = "$") -> Column:
    """The elements of an array at a path, as VARIANTs; NULL for anything else."""
    return F.try_variant_get(value, path, "array<variant>")


def as_text(value: Column, path: str, otherwise: str = "") -> Column:
    """A value as text; ``otherwise`` for what is missing, null, false, zero or an empty text."""
    read = F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))
    other = ~F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.lit(False))
    return F.when((read == "") | (other & read.isin("false", "0")), F.lit(otherwise)).otherwise(read)


def unwrapped(value: Column) -> Column:
    """The list in an object whose single key only wraps it (input, items, rows, data; none of its elements but objects); else the value itself."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    inner = F.get(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), F.lit(0))
    wraps = is_object(value) & (F.size(keys) == 1) & F.lower(F.trim(F.get(keys, F.lit(0)))).isin(WRAPPERS)
    only = F.forall(as_list(inner), is_object)
    return F.when(F.coalesce(wraps & only, F.lit(False)), inner).otherwise(value)


def json_rows(texts: DataFrame) -> DataFrame:
    """doc_id, row (from 0), value: the objects in a JSON array, or in the array ``rows`` of an object; other elements are left out and not counted."""
    value = texts.select("doc_id", parsed(F.col("text")).alias("v"))
    listed = value.select("doc_id", F.filter(F.coalesce(as_list(F.col("v")), F.when(is_object(F.col("v")), as_list(F.col("v"), "$.rows"))), is_object).alias("rows"))
    return listed.select("doc_id", F.posexplode("rows").alias("row", "value"))


def cells(rows: DataFrame) -> DataFrame:
    """doc_id, row, key, text, kind of every field of ``rows`` (doc_id, row, value)."""
    fields = rows.select("doc_id", "row", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("key", "v"))
    return fields.select("doc_id", "row", "key", F.try_variant_get("v", "$", "string").alias("text"), F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1).alias("kind"))


def target_rows(texts: DataFrame) -> DataFrame:
    """doc_id, root, fields: the root of a target's JSON (object, array or other), unwrapped, and the distinct keys of its object or of its elements."""
    value = texts.select("doc_id", unwrapped(parsed(F.col("text"))).alias("v"))
    elements = F.coalesce(F.filter(as_list(F.col("v")), is_object), F.array("v"))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform(elements, lambda e: F.coalesce(F.map_keys(F.try_variant_get(e, "$", "map<string,variant>")), F.array().cast("array<string>"))))))
    root = F.when(is_object(F.col("v")), "object").when(as_list(F.col("v")).isNotNull(), "array").otherwise("other")
    return value.select("doc_id", root.alias("root"), keys.alias("fields"))


def _found(text: str) -> str | None:
    """The first JSON in a text: the whole, what stands in a fence, else what begins at a bracket and closes."""
    whole = text.strip()
    for part in [whole, *(m[1].strip() for m in re.finditer(FENCE, whole, re.DOTALL | re.IGNORECASE))]:
        try:
            return json.dumps(json.loads(part), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            continue
    read = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", whole):
        try:
            return json.dumps(read.raw_decode(whole, m.start())[0], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            continue
    return None


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_found(t) if t else None for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "payload"])


def payloads(answers: DataFrame) -> DataFrame:
    """doc_id, payload: the JSON in a model's answer, canonical, NULL without one. Where brackets close can only be told by reading on from each."""
    return answers.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_payloads, "doc_id long, payload string")


def parsed_files(texts: DataFrame) -> DataFrame:
    """doc_id and the fields of a parsed file in its JSON, with what stands for missing ones, and its lists of objects: how many, and which are kept.

    No row for what is no object.
    """
    value = texts.select("doc_id", parsed(F.col("text")).alias("v")).where(is_object(F.col("v")))
    many = lambda path: F.coalesce(F.size(F.filter(as_list(F.col("v"), path), is_object)), F.lit(0))
    fields = {"file_name": "uploaded_file", "file_type": "unknown", "content_type": "unknown", "document_mode": "data_table_mode", "extraction_status": "unknown", "raw_text": ""}
    counts = ["rows", "text_blocks", "sections", "kv_pairs", "source_candidates", "sheets"]
    columns = F.transform(F.coalesce(as_list(F.col("v"), "$.columns"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$", "string"))
    return value.select("doc_id", *[as_text(F.col("v"), f"$.{k}", other).alias(k) for k, other in fields.items()], columns.alias("columns"), *[many(f"$.{k}").alias(f"n_{k}") for k in counts])


def file_pairs(texts: DataFrame) -> DataFrame:
    """doc_id, n (from 1), label, value, confidence of the pairs in a parsed file's JSON; a confidence of no known kind is medium."""
    pairs = texts.select("doc_id", F.posexplode(as_list(parsed(F.col("text")), "$.kv_pairs")).alias("n", "p")).where(is_object(F.col("p")))
    kind = as_text(F.col("p"), "$.confidence", "medium")
    return pairs.select("doc_id", (F.col("n") + 1).alias("n"), as_text(F.col("p"), "$.label").alias("label"), as_text(F.col("p"), "$.value").alias("value"), F.when(kind.isin(KINDS), kind).otherwise("medium").alias("confidence"))


def file_sheets(texts: DataFrame) -> DataFrame:
    """doc_id, sheet (from 1), name, columns, rows (JSON texts) of the sheets in a parsed file's JSON."""
    sheets = texts.select("doc_id", F.posexplode(as_list(parsed(F.col("text")), "$.sheets")).alias("n", "s")).where(is_object(F.col("s"))).withColumn("sheet", F.col("n") + 1)
    name = as_text(F.col("s"), "$.name")
    listed = lambda path: F.coalesce(as_list(F.col("s"), path), F.array().cast("array<variant>"))
    columns = F.transform(listed("$.columns"), lambda c: F.try_variant_get(c, "$", "string"))
    rows = F.transform(F.filter(listed("$.rows"), is_object), lambda r: F.to_json(r))
    return sheets.select("doc_id", "sheet", F.when(name == "", F.concat(F.lit("Sheet "), F.col("sheet").cast("string"))).otherwise(name).alias("name"), columns.alias("columns"), rows.alias("rows"))
