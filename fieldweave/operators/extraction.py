"""Text to structure: facts, key-values, sections, delimited tables, HTML lists; one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import texts as T

FACTS, PAIRS = 16, 32

# Labels of fields that stand inside one line of text, and how they are written.
INLINE = {
    "ФИО": r"(?:фио|full\s*name)",
    "дата рождения": r"(?:дата\s+рождения|birth\s*date)",
    "телефон": r"(?:телефон|phone(?:\s*number)?)",
    "email": r"(?:email|e-?mail)",
    "адрес": r"(?:адрес|address)",
    "цель документа": r"(?:цель\s+документа|document\s*purpose)",
}
#: A label and its value in one line, by colon, dash or two blanks; pairs parted by commas
LABEL_SHAPES = [r"^([^:]{2,80}?)\s*:\s*(.+)$", r"^([^-]{2,80}?)\s+-\s+(.+)$", r"^([A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9 /()#._]{1,60}?)\s{2,}(.+)$"]
WIDE_PAIR = r"([A-Za-zА-Яа-я0-9_()/ .-]{2,80}?)\s*:\s*(.+?)(?=(?:,\s*[A-Za-zА-Яа-я0-9_()/ .-]{2,80}?\s*:)|$)"


def _keyed(pairs: str) -> Column:
    """What pairs (label, value) are compared by: both, but for case."""
    return F.transform(pairs, lambda p: F.concat_ws("\x1f", F.lower(p["label"]), F.lower(p["value"])))


def _first_of_equal(pairs: str, keys: str, limit: int) -> Column:
    """Of the pairs in a column those that are the first of their key, at most ``limit``. Linear: equal keys are found by hash, and just ``limit`` are looked up."""
    return F.transform(F.slice(F.array_distinct(keys), 1, limit), lambda k: F.element_at(pairs, F.array_position(keys, k).cast("int")))


def _numbered(documents: DataFrame, pairs: Column | str) -> DataFrame:
    return documents.select("doc_id", F.posexplode(pairs).alias("n", "p")).select("doc_id", (F.col("n") + 1).alias("n"), "p.label", "p.value")


def text_facts(documents: DataFrame, limit: int = FACTS) -> DataFrame:
    """doc_id, n, label, value: "X is Y" sentences, the first of equal ones, at most ``limit`` a document."""

    def fact(s: Column) -> Column:
        out = F.lit(None)
        for shape in reversed(T.FACTS):
            label = F.substring(F.regexp_replace(F.regexp_extract(s, shape, 1), r"^[ \-:;,]+|[ \-:;,]+$", ""), 1, 60)
            value = F.trim(F.regexp_extract(s, shape, 2))
            out = F.when(s.rlike(shape) & (label != "") & (value != ""), F.struct(label.alias("label"), value.alias("value"))).otherwise(out)
        return out

    found = documents.select("doc_id", F.filter(F.transform(T.sentences(F.col("text")), fact), lambda p: p.isNotNull()).alias("pairs"))
    return _numbered(found.withColumn("keys", _keyed("pairs")), _first_of_equal("pairs", "keys", limit))


def _pair(line: Column) -> Column:
    """label and value of a line: parted by a colon, by a dash between blanks or by two blanks; the first that gives a valid pair."""
    out = F.lit(None)
    for shape in reversed(LABEL_SHAPES):
        label = F.regexp_replace(F.regexp_extract(line, shape, 1), r"^[ \-:;]+|[ \-:;]+$", "")
        value = F.trim(F.regexp_extract(line, shape, 2))
        valid = line.rlike(shape) & (label != "") & (value != "") & (F.length(label) <= 80) & (F.length(value) <= 220) & (T.word_count(label) <= 8)
        out = F.when(valid, F.struct(label.alias("label"), value.alias("value"))).otherwise(out)
    return out


def inline_pairs(text: Column) -> Column:
    """Pairs of known labels within running text, in any order: what stands between a label and the next is its value. None under two labels."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00a0]+", " "))
    every = "|".join(INLINE.values())
    labels = F.regexp_extract_all(plain, F.lit(rf"(?iu)\b({every})\b"), F.lit(1))
    parts = F.split(plain, rf"(?iu)\b(?:{every})\b")
    values = F.slice(parts, F.lit(2), F.size(parts))
    name = F.lit(None).cast("string")
    named = lambda x: [F.when(x.rlike(rf"(?iu)^{shape}$"), F.lit(label)) for label, shape in INLINE.items()]
    clean = lambda v: F.regexp_replace(v, r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")
    pairs = F.transform(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda x: F.struct(F.coalesce(*named(x["l"]), name).alias("label"), clean(x["v"]).alias("value")))
    valid = F.filter(pairs, lambda p: (p["value"] != "") & (F.length(p["value"]) <= 220))
    return F.when(F.size(labels) >= 2, valid).otherwise(F.slice(valid, 1, 0))


def key_values(documents: DataFrame, limit: int = PAIRS) -> DataFrame:
    """doc_id, n, label, value of lines that hold a label and a value, each pair once; of known labels inside a line if no more than one line does."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    lines = F.filter(F.transform(F.split(text, r"\r\n?|\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    by_line = documents.select("doc_id", F.filter(F.transform(lines, _pair), lambda p: p.isNotNull()).alias("pairs"), inline_pairs(text).alias("inline"))
    keyed = by_line.withColumns({"keys": _keyed("pairs"), "inline_keys": _keyed("inline")})
    both = keyed.select("doc_id", _first_of_equal("pairs", "keys", limit).alias("pairs"), _first_of_equal("inline", "inline_keys", limit).alias("inline"))
    return _numbered(both, F.when((F.size("inline") >= 2) & (F.size("pairs") <= 1), F.col("inline")).otherwise(F.col("pairs")))


def wide_pairs(paragraphs: DataFrame) -> DataFrame:
    """doc_id, row, place, label, value: paragraphs of two pairs or more parted by commas as rows of a wide table, if a document has two such rows.

    The columns are all labels of a document in order of their first appearance (``place``, from 1); a row without one has an empty value. Of
    equal labels in a row the last value counts.
    """
    matched = F.regexp_extract_all("paragraph", F.lit(WIDE_PAIR), F.lit(0))
    strip = lambda x: F.regexp_replace(x, r"^[ ,;]+|[ ,;]+$", "")
    pairs = F.transform(matched, lambda m: F.struct(strip(F.regexp_extract(m, WIDE_PAIR, 1)).alias("label"), strip(F.regexp_extract(m, r":\s*(.+)$", 1)).alias("value")))
    each = paragraphs.select("doc_id", "row", pairs.alias("pairs")).where(F.size("pairs") >= 2).withColumn("pairs", F.filter("pairs", lambda p: (p["label"] != "") & (p["value"] != "")))
    long = each.select("doc_id", "row", F.posexplode("pairs").alias("at", "p"))
    cells = long.groupBy("doc_id", "row", F.col("p.label").alias("label")).agg(F.max_by("p.value", "at").alias("value"), F.min("at").alias("at"))
    rows = cells.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("cells")).where(F.size("cells") >= 2)
    columns = cells.groupBy("doc_id", "label").agg(F.min(F.struct("row", "at")).alias("first")).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
    wide = columns.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("columns"))
    enough = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("doc_id")
    table = rows.join(enough, "doc_id", "left_semi").join(wide.where(F.size("columns") >= 2), "doc_id")
    return table.select("doc_id", "row", "cells", F.explode("columns").alias("c")).select("doc_id", "row", "c.place", "c.label", F.coalesce(F.try_element_at("cells", F.col("c.label")), F.lit("")).alias("value"))


def markdown_rows(documents: DataFrame) -> DataFrame:
    """doc_id, row, column, value of the first Markdown table of each text: a header, a rule, rows of as many cells."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    is_row = lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1)
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    first = F.array_position(F.transform("lines", is_row), F.lit(True))
    rest = F.slice("lines", first.cast("int"), F.size("lines"))
    stop = F.array_position(F.transform("rest", lambda x: ~is_row(x)), F.lit(True))
    found = documents.select("doc_id", lines.alias("lines")).where(first > 0).select("doc_id", rest.alias("rest"))
    found = found.select("doc_id", F.when(stop > 0, F.slice("rest", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("rest")).alias("table"))
    rule = F.forall(cells(F.get("table", F.lit(1))), lambda c: c.rlike(r"^:?-{3,}:?$"))
    found = found.where((F.size("table") >= 3) & rule).select("doc_id", cells(F.get("table", F.lit(0))).alias("names"), F.transform(F.slice("table", F.lit(3), F.size("table")), cells).alias("rows")).where(F.size("names") >= 2)
    rows = found.select("doc_id", "names", F.posexplode(F.filter("rows", lambda r: F.size(r) == F.size("names"))).alias("row", "cells"))
    return rows.select("doc_id", (F.col("row") + 1).alias("row"), F.explode(F.arrays_zip(F.col("names").alias("column"), F.col("cells").alias("value"))).alias("c")).select("doc_id", "row", "c.column", "c.value")


SECTIONS, BLOCKS = 12, 24


def sections(documents: DataFrame, limit: int = SECTIONS) -> DataFrame:
    """doc_id, section, title, text: paragraphs under the running heading, 'Document' before the first; at most ``limit`` a document.

    A heading without a paragraph opens no section. A document of headings only is one section of its first three paragraphs.
    """
    whole = documents.select("doc_id", T.paragraphs(F.col("text")).alias("all"))
    each = whole.select("doc_id", F.posexplode("all").alias("at", "paragraph")).withColumn("heading", T.is_heading(F.col("paragraph")))
    so_far = Window.partitionBy("doc_id").orderBy("at")
    placed = each.withColumn("part", F.count_if("heading").over(so_far)).withColumn("title", F.coalesce(F.last(F.when(F.col("heading"), F.col("paragraph")), ignorenulls=True).over(so_far), F.lit("Document")))
    body = placed.where("not heading").groupBy("doc_id", "part").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("at", "paragraph"))).alias("body"))
    numbered = body.withColumn("section", F.row_number().over(Window.partitionBy("doc_id").orderBy("part"))).where(F.col("section") <= limit)
    found = numbered.select("doc_id", "section", "title", F.array_join(F.transform("body", lambda p: p["paragraph"]), "\n\n").alias("text"))
    bare = whole.where(F.size("all") > 0).where(F.forall("all", T.is_heading))
    return found.unionByName(bare.select("doc_id", F.lit(1).alias("section"), F.lit("Document").alias("title"), F.array_join(F.slice("all", 1, 3), "\n\n").alias("text")))


def text_blocks(documents: DataFrame, limit: int = BLOCKS) -> DataFrame:
    """doc_id, n, block, label: the first ``limit`` paragraphs of each document; one that reads like a heading is its own label."""
    blocks = documents.select("doc_id", F.posexplode(F.slice(T.paragraphs(F.col("text")), 1, limit)).alias("n", "block"))
    return blocks.select("doc_id", (F.col("n") + 1).alias("n"), "block", F.when(T.is_heading(F.col("block")), F.col("block")).alias("label"))


def delimited_tables(documents: DataFrame, delimiters: tuple[str, ...] = ("\t", "|", ";", ",", "  ")) -> DataFrame:
    """doc_id, block, delimiter, columns, rows: blocks whose every line splits into two cells or more; the best delimiter of each.

    The first line is the header and needs two filled cells; shorter rows are padded, longer ones cut, empty ones and Markdown rules dropped. Two blanks
    or more are a delimiter, too; a line of pipes needs two of them. Score is columns * (rows + 1); of equal scores the earlier delimiter wins.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    blank = F.when(F.trim(F.regexp_replace("line", r"\s+", " ")) == "", 1).otherwise(0)
    lines = lines.withColumn("block", F.sum(blank).over(Window.partitionBy("doc_id").orderBy("at"))).where(blank == 0)
    blocks = lines.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")))).alias("b")).where(F.size("b") >= 2)
    blocks = blocks.select("doc_id", "block", F.transform("b", lambda x: x["line"]).alias("lines"))

    def split(d: str) -> Column:
        """The cells of each line, if all lines have the delimiter; else NULL."""
        shape = {"|": r"\|", "  ": r"\s{2,}"}.get(d, d)
        bare = (lambda x: F.regexp_replace(x, r"^\|+|\|+$", "")) if d == "|" else (lambda x: x)
        cells = F.transform("lines", lambda x: F.transform(F.split(bare(x), shape), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))))
        here = {"|": lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2, "  ": lambda x: x.rlike(shape)}.get(d, lambda x: F.contains(x, F.lit(d)))
        return F.when(F.forall("lines", here), cells)

    def table(k: int, d: str) -> Column:
        rows = F.col(f"rows{k}")
        head = F.get(rows, F.lit(0))
        filled = F.size(F.filter(F.slice(rows, F.lit(2), F.size(rows)), lambda r: F.exists(F.slice(r, F.lit(1), F.size(head)), lambda x: x != "")))
        good = (F.size(rows) >= 2) & (F.size(F.filter(head, lambda x: x != "")) >= 2) & (filled > 0)
        return F.when(good, F.struct((F.size(head) * (filled + 1)).alias("score"), F.lit(-k).alias("rank"), F.lit(d).alias("delimiter"), F.size(head).alias("columns"), filled.cast("long").alias("rows")))

    # Lines are split once for each delimiter, and what is left of them kept as a column
    rule = lambda c: F.forall(F.filter(c, lambda x: x != ""), lambda x: x.rlike(r"^:?-{3,}:?$")) & F.exists(c, lambda x: x != "")
    cut = blocks.select("doc_id", "block", *[split(d).alias(f"cells{k}") for k, d in enumerate(delimiters)])
    rows = lambda k, d: F.when(F.forall(f"cells{k}", lambda c: F.size(c) >= 2), F.filter(f"cells{k}", lambda c: ~rule(c)) if d == "|" else F.col(f"cells{k}"))
    kept = cut.select("doc_id", "block", *[rows(k, d).alias(f"rows{k}") for k, d in enumerate(delimiters)])
    best = kept.select("doc_id", "block", F.array_max(F.array(*[table(k, d) for k, d in enumerate(delimiters)])).alias("t"))
    return best.where("t is not null").select("doc_id", "block", "t.delimiter", "t.columns", "t.rows")


def html_items(pages: DataFrame) -> DataFrame:
    """page_id, n, item: plain text of list items."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"(?si)<li[^>]*>(.*?)</li>"), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("n", "raw")).select("page_id", (F.col("n") + 1).alias("n"), T.stripped(F.col("raw")).alias("item"))


def html_tables(pages: DataFrame) -> DataFrame:
    """page_id, row, cells: plain text of the cells of every table row."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(r"(?si)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "raw"))
    cells = F.regexp_extract_all(F.col("raw"), F.lit(r"(?si)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return rows.select("page_id", (F.col("row") + 1).alias("row"), F.transform(cells, T.stripped).alias("cells"))


def file_kind(content: Column) -> Column:
    """Kind of a file by its first bytes: pdf, xlsx, docx, json or text."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(head.startswith("PK") & head.contains("xl/"), "xlsx")
        .when(head.startswith("PK") & head.contains("word/"), "docx")
        .when(F.trim(head).startswith("[") | F.trim(head).startswith("{"), "json")
        .otherwise("text")
    )


def document_kind(documents: DataFrame) -> DataFrame:
    """doc_id, content_type and status by what the extractors find: tables, key-value pairs, text of 16 characters or more."""
    tables = delimited_tables(documents).select("doc_id").distinct().withColumn("tables", F.lit(True))
    pairs = key_values(documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"))
    both = documents.select("doc_id", F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("chars")).join(tables, "doc_id", "left").join(pairs, "doc_id", "left")
    has, n, long = F.col("tables").isNotNull(), F.coalesce("pairs", F.lit(0)), F.coalesce("chars", F.lit(0)) >= 16
    kind = F.when(has & ((n > 0) | long), "mixed").when(has, "table").when(n >= 2, "form").when(long, "text").otherwise("image_like")
    status = F.when(has, "structured_extracted").when((n >= 2) | long, "text_extracted").otherwise("text_not_extracted")
    return both.select("doc_id", kind.alias("content_type"), status.alias("status"))


def deduped(candidates: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of candidates that agree in ``key`` (such as document, type, label and value) but for case the first."""
    same = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in key]
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(order))).where("_n = 1").drop("_n")
