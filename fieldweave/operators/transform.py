"""Row transformation and validation: mapped sources to typed, nested targets as one projection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import values as V


def target_fields(example: str) -> list[tuple[str, str, bool]]:
    """(dotted path, type, required) of a target given as a JSON example; an array's items are merged.

    A single wrapper input, items, rows or data is taken off. Duplicate keys, empty names and items of different types are errors.
    """

    def pairs(found: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in found}) < len(found):
            raise ValueError("a key occurs twice")
        if any(not k for k, _ in found):
            raise ValueError("a key is empty")
        return dict(found)

    import re

    value = json.loads(re.sub(r",(\s*[}\]])", r"\1", example.lstrip("﻿")), object_pairs_hook=pairs)
    if isinstance(value, dict) and len(value) == 1 and next(iter(value)) in ("input", "items", "rows", "data") and isinstance(next(iter(value.values())), (list, dict)):
        value = next(iter(value.values()))

    def kind(x: object) -> str:
        return {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(x)]

    def merged(items: list) -> dict[str, tuple[str, bool, object]]:
        if any(not isinstance(i, dict) for i in items):
            raise ValueError("items are not objects")
        keys = list(dict.fromkeys(k for i in items for k in i)) if len(items) < 2 else sorted({k for i in items for k in i})
        out = {}
        for k in keys:
            have = [i[k] for i in items if k in i]
            kinds = {kind(x) for x in have} - {"null"}
            if len(kinds) > 1:
                raise ValueError(f"{k} has items of different types")
            out[k] = (kinds.pop() if kinds else "null", len(have) == len(items), [x for x in have if x is not None])
        return out

    def walk(items: list, prefix: str, needed: bool) -> list[tuple[str, str, bool]]:
        out = []
        for k, (what, required, have) in merged(items).items():
            if what == "object":
                out += walk(have, f"{prefix}{k}.", needed and required)
            else:
                out.append((f"{prefix}{k}", what, needed and required))
        return out

    return walk(value if isinstance(value, list) else [value], "", True)


CASTS = {"number": V.to_number, "boolean": V.to_boolean}


def transformed(rows: DataFrame, mapping: dict[str, str | None], fields: list[tuple[str, str, bool]], keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, the nested targets, and _cast_errors (path, raw) where a value did not fit its type.

    One projection without a Python function; an unmapped target is NULL. A path that is a value and a parent is an error.
    """
    paths = [p for p, _, _ in fields]
    if any(q.startswith(p + ".") for p in paths for q in paths):
        raise ValueError("a path is both a value and a parent")
    cells: dict[str, Column] = {}
    errors = []
    for path, what, _ in fields:
        source = mapping.get(path)
        raw = F.col(source).cast("string") if source else F.lit(None).cast("string")
        cells[path] = CASTS.get(what, lambda x: x)(raw)
        if what == "number":
            errors.append(F.when(V.visible(raw) & cells[path].isNull(), F.struct(F.lit(path).alias("path"), raw.alias("raw"))))

    def nested(prefix: str) -> list[Column]:
        out, seen = [], set()
        for p in paths:
            if p.startswith(prefix):
                head = p[len(prefix) :].split(".")[0]
                if head not in seen:
                    seen.add(head)
                    full = prefix + head
                    out.append((cells[full] if full in cells else F.struct(*nested(full + "."))).alias(head))
        return out

    bad = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<struct<path:string,raw:string>>")
    return rows.select(*keep, *nested(""), bad.alias("_cast_errors"))


def diagnostics(result: DataFrame, fields: list[tuple[str, str, bool]], keep: list[str] = ()) -> DataFrame:
    """One row per fault: ``keep``, path and code (type_mismatch, missing_required_field); of all rows, not of the first few."""
    bad = F.transform("_cast_errors", lambda e: F.struct(e["path"].alias("path"), F.lit("type_mismatch").alias("code")))
    failed = F.transform("_cast_errors", lambda e: e["path"])
    missing = [
        F.when(F.col(p).isNull() & ~F.array_contains(failed, p), F.struct(F.lit(p).alias("path"), F.lit("missing_required_field").alias("code")))
        for p, _, required in fields
        if required
    ]
    return result.select(*keep, F.explode(F.concat(bad, F.array_compact(F.array(*missing)))).alias("fault")).select(*keep, "fault.path", "fault.code")


def filled_enough(rows: DataFrame, columns: list[str], share: float = 0.35) -> DataFrame:
    """Rows of which at least ``share`` of the cells are filled."""
    filled = sum((F.when(V.visible(F.col(c).cast("string")), 1).otherwise(0) for c in columns), F.lit(0))
    return rows.where(filled / len(columns) >= share)


def wide(pairs: DataFrame, key: str, name: str, value: str, names: list[str], order: str) -> DataFrame:
    """(name, value) rows as one row per key; the last value in ``order`` wins, blanks do not count."""
    return pairs.where(V.visible(F.col(value))).groupBy(key).pivot(name, names).agg(F.max_by(value, order))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of empty cells, distinct values, inferred type (boolean and number only if all values are)."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    seen = V.visible(F.col("value"))
    per = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~seen | F.col("value").isNull()).alias("empty"),
        F.count_distinct(F.when(seen, F.col("value"))).alias("distinct_values"),
        F.coalesce(F.every(F.when(seen, V.parse_boolean(F.col("value")).isNotNull())), F.lit(False)).alias("all_boolean"),
        F.coalesce(F.every(F.when(seen, V.parse_number(F.col("value")).isNotNull())), F.lit(False)).alias("all_number"),
    )
    kind = F.when(F.col("empty") == F.col("n"), "null").when(F.col("all_boolean"), "boolean").when(F.col("all_number"), "number").otherwise("string")
    return per.select("column", "n", (F.col("empty") / F.col("n")).alias("null_ratio"), "distinct_values", kind.alias("type"))


def typescript(fields: list[tuple[str, str, bool]], name: str = "Target") -> str:
    """An interface for the target, nested like its paths."""

    def body(prefix: str, indent: int) -> list[str]:
        out, seen = [], set()
        for p, what, required in fields:
            if not p.startswith(prefix):
                continue
            head, _, rest = p[len(prefix) :].partition(".")
            if head in seen:
                continue
            seen.add(head)
            pad, mark = "  " * indent, "" if required else "?"
            if rest:
                out += [f"{pad}{head}{mark}: {{", *body(f"{prefix}{head}.", indent + 1), f"{pad}}};"]
            else:
                out.append(f"{pad}{head}{mark}: {what if what in ('string', 'number', 'boolean') else 'unknown'};")
        return out

    return "\n".join([f"export interface {name} {{", *body("", 1), "}"])
