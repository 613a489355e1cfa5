"""Benchmark decontamination by template canonicalisation, in DataFrame and SQL functions only.

Words are runs between whitespace. Canonically, a capitalised word that does not begin a sentence is a name, a word of digits
and their marks is a number, a unit after a number is a unit; each gives way to its typed placeholder, other words to
their lower case. A window is ``WINDOW`` such words; its first word is never a name or unit, for what stands before it is not the window's,
so that a question is the same window after any other text. Windows of the benchmark are hashed, those with under ``LITERALS`` other
words by their plain lower-case words, and document windows meet them in hash joins, so re-parameterised questions meet as well as copies.

1. Hashes only: documents without any hash of the benchmark's go. Window hashes are made inside the row and nothing else travels.
2. In the documents that are left the windows themselves are compared and grouped by document, item and alignment. Slots are consistent
   if, within an alignment, an equal value of the item always became an equal value of the document; windows that hold a value for which
   that fails are dropped. A document is contaminated by an item of which at least ``COVERAGE`` of the windows are matched.

Defined cases: null or empty text and items match nothing; an item of fewer than WINDOW words is one window of its length;
repeated items and documents are reported once by id; documents with a null doc_id are reported together under null; an id of several
texts counts the windows of its longest; very long texts are read whole; other columns are ignored. Benchmark hashes are
broadcast up to a checked count and shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.workspace import narrow, stored

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
BROADCAST = 50_000  # windows of at most 2 * WINDOW words: some tens of MB
UNITS = "kg|g|mg|lb|oz|km|m|cm|mm|mile|miles|ft|feet|inch|inches|hour|hours|h|minute|minutes|min|second|seconds|s|day|days|week|weeks|month|months|year|years|dollar|dollars|usd|euro|euros|percent|l|liter|liters|litre|litres|ml|mph"
NAME, NUMBER, UNIT = "<name>", "<number>", "<unit>"


def _plain(text: Column) -> Column:
    """Words with single spaces between them."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))


def _canonical(plain: Column) -> Column:
    out = F.regexp_replace(plain, r"(?<=[^.!?] )\p{Lu}[^ ]*", NAME)
    out = F.regexp_replace(out, r"(?<![^ ])[\"'(\[$€£+-]*[0-9][0-9.,:/%-]*[)\]\"';!?]*(?![^ ])", NUMBER)
    out = F.regexp_replace(out, rf"(?i)(?<={NUMBER} )(?:{UNITS})[.,;:!?]*(?![^ ])", UNIT)
    return F.lower(out)


def _split(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, plain, canonical (array) and lowered (array) of texts (keys, plain)."""
    return texts.select(*keys, "plain", F.split(_canonical(F.col("plain")), " ").alias("canonical"), F.split(F.lower("plain"), " ").alias("lowered"))


def _template(at: Column, size: int) -> Column:
    """The window of ``size`` words from place ``at`` (from 1)."""
    first = F.when(F.get("canonical", at - 1) == NUMBER, F.lit(NUMBER)).otherwise(F.get("lowered", at - 1))
    return F.concat(F.array(first), F.slice("canonical", at + 1, F.lit(size - 1)))


def _marked(split: DataFrame) -> DataFrame:
    """``split`` with a hash of each canonical word and of each word as the first of a window, so that no window hashes strings again."""
    first = F.transform("canonical", lambda x, i: F.when(x == NUMBER, F.xxhash64(F.lit(NUMBER))).otherwise(F.xxhash64(F.get("lowered", i))))
    return split.withColumn("marks", F.transform("canonical", lambda x: F.xxhash64(x))).withColumn("firsts", first)


def _hash(at: Column, size: int, literal: bool) -> Column:
    if literal:
        return F.xxhash64(F.lit(True), F.slice("lowered", at, F.lit(size)))
    return F.xxhash64(F.lit(False), F.get("firsts", at - 1), F.slice("marks", at + 1, F.lit(size - 1)))


def _windows(size: int, each) -> Column:
    """``each(place)`` for every window of the row; an empty array for shorter texts."""
    count = F.size("canonical") - (size - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), each)
    return F.when((count > 0) & (F.size("lowered") > 0), every).otherwise(F.slice(every, 1, 0))


def _is_slot(x: Column) -> Column:
    return x.isin(NAME, NUMBER, UNIT)


def _asked(items: DataFrame) -> DataFrame:
    """item_id, size, item_at, literal, hash, template and item_words (lower case) of every window of the items (item_id, plain)."""
    split = _split(items, ["item_id"]).withColumn("size", F.least(F.size("canonical"), F.lit(WINDOW)))
    at = split.select("item_id", "size", "canonical", "lowered", F.explode(F.sequence(F.lit(1), F.size("canonical") - F.col("size") + 1)).alias("item_at"))
    first = F.when(F.get("canonical", F.col("item_at") - 1) == NUMBER, F.lit(NUMBER)).otherwise(F.get("lowered", F.col("item_at") - 1))
    at = at.select("item_id", "size", "item_at", F.concat(F.array(first), F.slice("canonical", F.col("item_at") + 1, F.col("size") - 1)).alias("template"), F.slice("lowered", "item_at", "size").alias("item_words"))
    at = at.withColumn("literal", F.size(F.filter("template", lambda x: ~_is_slot(x))) < F.least(F.lit(LITERALS), F.col("size")))
    words = F.transform("template", lambda x: F.xxhash64(x))
    return at.withColumn("hash", F.when(F.col("literal"), F.xxhash64(F.lit(True), "item_words")).otherwise(F.xxhash64(F.lit(False), F.get(words, F.lit(0)), F.slice(words, F.lit(2), F.col("size") - 1))))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, kind (copy or template) for every contaminated document and its items."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), _plain(F.col("text")).alias("plain")).where("plain <> ''")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _plain(F.col("text")).alias("plain")).where("plain <> '' and item_id is not null").distinct()
    asked = stored(_asked(items), "asked")
    kinds = [tuple(r) for r in asked.select("size", "literal").distinct().orderBy("size", "literal").collect()]  # 2 * WINDOW rows at most
    hashes = narrow(stored(asked.select("hash").distinct(), "hashes"))

    hashed = lambda size, literal: _windows(size, lambda at: _hash(at, size, literal))
    made = [hashed(*kind) for kind in kinds] or [F.array().cast("array<bigint>")]
    seen = _marked(_split(docs, ["doc_id", "text_key"])).select("doc_id", "text_key", F.explode(F.concat(*made)).alias("hash"))
    near = narrow(stored(seen.join(hashes, "hash", "left_semi").select("doc_id", "text_key").distinct(), "near"))

    own = docs.join(near.withColumnRenamed("doc_id", "near_id"), F.col("doc_id").eqNullSafe(F.col("near_id")) & (docs["text_key"] == near["text_key"]), "left_semi")
    whole = lambda size, literal: _windows(size, lambda at: F.struct(_hash(at, size, literal).alias("hash"), at.alias("at"), _template(at, size).alias("template"), F.slice("lowered", at, F.lit(size)).alias("doc_words")))
    made = [whole(*kind) for kind in kinds]
    shape = "array<struct<hash:bigint,at:int,template:array<string>,doc_words:array<string>>>"
    windows = _marked(_split(own, ["doc_id"])).select("doc_id", F.explode(F.concat(*made) if made else F.array().cast(shape)).alias("w")).select("doc_id", "w.*")
    met = windows.withColumnRenamed("template", "doc_template").join(F.broadcast(asked) if asked.count() <= BROADCAST else asked, "hash")
    met = met.where((F.size("doc_words") == F.col("size")) & F.when(F.col("literal"), F.col("doc_words") == F.col("item_words")).otherwise(F.col("doc_template") == F.col("template")))

    slots = F.transform(F.filter(F.arrays_zip("template", "item_words", "doc_words"), lambda x: _is_slot(x["template"])), lambda x: F.struct(F.struct(x["template"], x["item_words"]).alias("of"), x["doc_words"].alias("is"), (x["item_words"] == x["doc_words"]).alias("same")))
    aligned = met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), F.struct("item_at", slots.alias("slots")).alias("m")).groupBy("doc_id", "item_id", "shift").agg(F.collect_set("m").alias("matched"))
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten(F.transform("matched", lambda m: m["slots"]))))
    twice = F.filter("slots", lambda s: F.size(F.filter("slots", lambda other: other["of"] == s["of"])) > 1)
    aligned = aligned.withColumn("torn", F.transform(twice, lambda s: s["of"]))
    kept = aligned.select("doc_id", "item_id", F.explode(F.filter("matched", lambda m: ~F.exists(m["slots"], lambda s: F.array_contains("torn", s["of"])))).alias("m"))

    n = F.size(F.split("plain", " "))
    usable = items.groupBy("item_id").agg(F.max(n - F.least(n, F.lit(WINDOW)) + 1).alias("windows"))
    by_item = kept.groupBy("doc_id", "item_id").agg(F.count_distinct("m.item_at").alias("n"), F.every(F.forall("m.slots", lambda s: s["same"])).alias("same"))
    out = by_item.join(narrow(stored(usable, "usable")), "item_id").withColumn("coverage", F.col("n") / F.col("windows")).where(F.col("coverage") >= COVERAGE)
    return out.select("doc_id", "item_id", "coverage", F.when(F.col("same"), "copy").otherwise("template").alias("kind"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns; a null doc_id is kept."""
    return documents.join(leaks(documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
