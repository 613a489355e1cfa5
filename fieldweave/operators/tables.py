"""Recovered tables in long form: signatures, blocks, types, widths, unique names, differences, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldweave.functions import values as V


def header_score(headers: list[str], expected: list[str]) -> int:
    """5 for each pair of equal names, 2 for each pair of which one is part of the other; letters and digits count only."""
    plain = lambda names: [p for p in ("".join(ch for ch in n.lower() if ch.isalnum()) for n in names) if p]
    return sum(5 if h == e else 2 if h in e or e in h else 0 for h in plain(headers) for e in plain(expected))


def best_row_group(rows: DataFrame, columns: list[str], expected: list[str]) -> DataFrame:
    """Rows of the best group of equal filled columns; all rows if no group scores above 0. Of equal scores the larger group wins."""
    signature = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(V.visible(F.col(c).cast("string")), F.lit(c)) for c in columns]))), "|")
    signed = rows.withColumn("signature", signature)
    groups = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    score = sum((F.when(F.array_contains(F.split("signature", r"\|"), c), header_score([c], expected)).otherwise(0) for c in columns), F.lit(0))
    best = groups.withColumn("score", score).agg(F.max(F.struct("score", "n", "signature")).alias("b")).select("b.*")  # one row
    return signed.join(F.broadcast(best.select(F.col("signature").alias("best"), "score")), (F.col("score") <= 0) | (F.col("signature") == F.col("best"))).drop("best", "score")


def blocks(rows: DataFrame, table: str, order: str, text: str) -> DataFrame:
    """Rows with ``block``, counted up at every blank row; blank rows themselves go."""
    blank = F.when(V.visible(F.col(text)), 0).otherwise(1)
    return rows.withColumn("block", F.sum(blank).over(Window.partitionBy(table).orderBy(order))).where(V.visible(F.col(text)))


def first_of_equal(rows: DataFrame, key: list, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def column_types(cells: DataFrame) -> DataFrame:
    """table, col, type: date if as many cells can be repaired to dates as to numbers or stay text, else number by the same rule, else text."""
    value = F.col("value")
    kind = F.when(V.repair_date(value).isNotNull(), "date").when(V.repair_number(value).isNotNull(), "number").when(V.visible(value), "text")
    n = cells.groupBy("table", "col").agg(F.count_if(kind == "date").alias("d"), F.count_if(kind == "number").alias("m"), F.count_if(kind == "text").alias("t"))
    return n.select("table", "col", F.when((F.col("d") > 0) & (F.col("d") >= F.greatest("m", "t")), "date").when((F.col("m") > 0) & (F.col("m") >= F.greatest("d", "t")), "number").otherwise("text").alias("type"))


def repaired_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (table, col, value) with their column's type and ``repaired``: the value as that type, empty where it cannot be one."""
    typed = cells.join(column_types(cells), ["table", "col"])
    plain = F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " "))
    empty = F.lit("")
    return typed.withColumn("repaired", F.when(F.col("type") == "number", F.coalesce(V.repair_number(plain), empty)).when(F.col("type") == "date", F.coalesce(V.repair_date(plain), empty)).otherwise(V.one_script(plain)))


def dominant_width(rows: DataFrame, table: str, width: str) -> DataFrame:
    """Each table's most frequent cell count; of equally frequent ones the larger."""
    n = rows.groupBy(table, width).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(table).agg(F.max_by(width, F.struct("n", width)).alias("width"), F.max("n").alias("rows"))


# How cells of each kind are written.
def cell_kind(value: Column) -> Column:
    """date, number, identifier, organization, person or text, by a cell's spelling."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ][0-9:.]+Z?)?$") | text.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), "date")
        .when(text.rlike(r"^[+-]?\d+(?:[.,]\d+)?$"), "number")
        .when(F.lower(text).rlike(r"^(?:deal[_-]|sales-)"), "identifier")
        .when(text.rlike(r"(?iu)^(?:ООО|АО|ОАО|ЗАО|ПАО|ИП)(?![\p{L}\p{N}_])"), "organization")
        .when(text.rlike(r"^\p{Lu}[^ ]* \p{Lu}"), "person")
        .otherwise("text")
    )


def _columns_of(cells: DataFrame) -> DataFrame:
    """doc_id, width, column, kind (the most frequent; of equals the first), top, all, kinds, of flat cells (doc_id, at, value, width)."""
    typed = cells.groupBy("doc_id", "width", (F.col("at") % F.col("width")).alias("column"), cell_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    return typed.groupBy("doc_id", "width", "column").agg(
        F.max_by("kind", F.struct("n", (-F.col("first")).alias("first"))).alias("kind"), F.max("n").alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.bool_or(F.col("kind") == "text").alias("has_text")
    )


def _widths(cells: DataFrame, most: int) -> DataFrame:
    """doc_id, width, column, kind, score, best (doc_id's width and its score) of flat cells (doc_id, at, value), under every width.

    All of it is grouped or windowed by doc_id; widths are not joined back, so no side can be sent to the driver and from there to all.
    """
    sized = cells.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    each = sized.withColumn("width", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(most), F.floor(F.col("n") / 2)))))).where("n % width = 0 and width * 2 <= n")
    score = F.col("top") / F.col("all") + F.when((F.col("kinds") == 1) & ~F.col("has_text"), 0.5).otherwise(0.0)
    scored = _columns_of(each).withColumn("score", F.round(F.sum(score).over(Window.partitionBy("doc_id", "width")), 6))
    return scored.withColumn("best", F.max(F.struct("score", (-F.col("width")).alias("w"))).over(Window.partitionBy("doc_id")))


def repeated_width(cells: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, width, score: the width under which a flat list of cells (doc_id, at, value) makes rows of the purest columns; the least of equals.

    Widths divide the number of cells into two rows or more. A column scores the share of its main kind, and a half more if it is the only
    one and not text; a width scores the sum over its columns.
    """
    return _widths(cells, most).where("column = 0 and width = -best.w").select("doc_id", "width", "score")


def repeated_columns(cells: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, column, name of flat cells under their repeated width: named by the column's kind and place, equal names numbered from 2."""
    kinds = _widths(cells, most).where("width = -best.w")
    last = F.max(F.when(F.col("column") == F.col("width") - 1, F.col("kind"))).over(Window.partitionBy("doc_id"))
    named = {"identifier": "identifier", "date": "date", "number": "amount", "organization": "organization", "person": "responsible"}
    at, width = F.col("column"), F.col("width")
    by_kind = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    place = F.when(width >= 6, F.when(at == 1, "name").when(at == 3, "stage").when((at == width - 2) & (F.col("last") == "person"), "product"))
    name = F.coalesce(F.try_element_at(by_kind, F.col("kind")), place, F.concat(F.lit("column"), (at + 1).cast("string")))
    out = kinds.withColumn("last", last).withColumn("name", name)
    nth = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("column"))
    return out.select("doc_id", "column", F.when(nth == 1, F.col("name")).otherwise(F.concat("name", nth.cast("string"))).alias("name"))


def flat_cells(paragraphs: DataFrame) -> DataFrame:
    """doc_id, at, value of the filled cells between a paragraph's pipes; paragraphs (doc_id, text) with under four are left out."""
    cells = F.filter(F.transform(F.split("text", r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    return paragraphs.where(F.contains("text", F.lit("|"))).select("doc_id", cells.alias("cells")).where(F.size("cells") >= 4).select("doc_id", F.posexplode("cells").alias("at", "value"))


def _renamer(gap: str) -> Callable:
    """Unique names of rows (group, name) that come sorted by group and place; a group's names so far are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, next_free = object(), set(), {}
        for batch in batches:
            out = []
            for group, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != now:
                    now, used, next_free = group, set(), {}
                new = name
                if name is not None and name in used:
                    k = next_free.get(name, 2)
                    while f"{name}{gap}{k}" in used:
                        k += 1
                    next_free[name], new = k + 1, f"{name}{gap}{k}"
                used.add(new)
                out.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "unique"])

    return run


def unique_names(names: DataFrame, group: str, order: str, name: str, gap: str = "") -> DataFrame:
    """``names`` with ``unique``: a name that an earlier one of its group has got is given ``gap`` and the least number from 2 that makes it new.

    What a name gets depends on what all earlier ones have got, so a group is read in order, by one task; many groups share it. Later names play
    no part: of a, a, "a 2" the last becomes "a 2 2".
    """
    rest = [c for c in names.columns if c not in (group, name)]
    rows = names.select(group, name, *rest)
    dealt = rows.repartition(group).sortWithinPartitions(group, order)
    return dealt.mapInArrow(_renamer(gap), StructType([*rows.schema.fields, StructField("unique", StringType())]))


def header_names(cells: DataFrame, table: str, order: str, name: str) -> DataFrame:
    """``cells`` with ``unique``: a header cell with blanks squeezed, column_i if it is empty, and _k behind the k-th that is equal but for case."""
    place = F.row_number().over(Window.partitionBy(table).orderBy(order))
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"\s+", " "))
    named = cells.withColumn("_i", place).withColumn("_name", F.when(plain == "", F.concat(F.lit("column_"), F.col("_i").cast("string"))).otherwise(plain))
    k = F.row_number().over(Window.partitionBy(table, F.lower("_name")).orderBy("_i"))
    return named.withColumn("_k", k).withColumn("unique", F.when(F.col("_k") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("_"), F.col("_k").cast("string")))).drop("_i", "_name", "_k")


def quote_aware(line: Column, delimiter: str) -> Column:
    """The cells of a delimited line; delimiters within double quotes do not part, doubled quotes are one, blanks around cells go."""
    outside = F.split(line, '"')
    marked = F.transform(outside, lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(delimiter), F.lit("\x01"))).otherwise(part))
    cells = F.split(F.array_join(marked, '"'), "\x01")
    bare = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) >= 2), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(cells, lambda c: F.trim(bare(F.trim(c))))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change: initial, removed, changed or unchanged, by a hash of each row."""
    mark = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    both = old.select(key, mark.alias("a")).join(new.select(key, mark.alias("b")), key, "full_outer")
    return both.select(key, F.when(F.col("a").isNull(), "initial").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("change"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts' canonical JSON array."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def delimiter(text: Column, choices: tuple[str, ...] = (";", "\t", ",", "|")) -> Column:
    """The delimiter that occurs most often outside double quotes in the whole text; the first of equals."""
    outside = F.array_join(F.filter(F.split(text, '"'), lambda part, i: i % 2 == 0), "")
    counts = [F.struct((F.length(outside) - F.length(F.replace(outside, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(choices)]
    return F.array_max(F.array(*counts))["d"]


def usable_text(text: Column) -> Column:
    """Whether extracted text is good enough not to be read again: long or in lines, with letters and few bad characters."""
    bad = F.regexp_count(text, F.lit("[�\x00-\x08]")) / F.greatest(F.length(text), F.lit(1))
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.size(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != ""))
    return ((F.length(plain) >= 80) | (lines >= 3)) & (bad <= 0.01) & (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= 40)


def owners(items: DataFrame, dims: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``items`` (kind, ref) with the owner named by the table of their kind: one equi-join for each kind, not an OR of all."""
    out = items
    for kind, (dim, key, name) in dims.items():
        side = dim.select(F.lit(kind).alias("_kind"), F.col(key).alias("_ref"), F.col(name).cast("string").alias(f"_{kind}"))
        out = out.join(side, (F.col("kind") == F.col("_kind")) & (F.col("ref") == F.col("_ref")), "left").drop("_kind", "_ref")
    return out.withColumn("owner", F.coalesce(*[F.col(f"_{k}") for k in dims])).drop(*[f"_{k}" for k in dims])


def token_users(log: DataFrame, tokens: list[str]) -> DataFrame:
    """token, users: distinct users whose labels hold the token as a word; labels are split into words, so tokens meet them in an equi-join."""
    asked = log.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    labels = log.select("user_id", "source").distinct().select("user_id", F.explode(F.array_distinct(F.split(F.lower("source"), r"[^\p{L}\p{N}]+"))).alias("token"))
    return labels.join(F.broadcast(asked), "token").groupBy("token").agg(F.count_distinct("user_id").alias("users"))
