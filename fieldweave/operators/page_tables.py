"""Tables over pages: continuations under the first table's two columns, cells under the nearest header, columns of a page, sections with their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import form_texts as T
from fieldweave.functions import values as V

# Parts of headers that name texts and codes, names given to columns without one, and how wide a column of a page is.
TEXT_HEADERS = ["наимен", "описан", "description", "name", "label", "вид"]
CODE_HEADERS = ["код", "code", "id", "номер"]
PLACEHOLDER = r"(?i)^column\d+$"
COLUMN_GAP = 120.0
SAMPLE = 5


def _told(cells: DataFrame, value: str = "value") -> DataFrame:
    """Cells with ``value`` trimmed, whether it is a code, whether it is words: with a letter, no code and no made-up column name."""
    plain = cells.withColumn(value, F.trim(F.coalesce(value, F.lit(""))))
    coded = plain.withColumns({"is_code": V.is_code(F.col(value)), "made_up": F.col(value).rlike(PLACEHOLDER)})
    return coded.withColumn("is_text", F.col(value).rlike(r"\p{L}") & ~F.col("made_up") & ~F.col("is_code"))


def _holds(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def _text_score(name: Column, texts: Column) -> Column:
    return F.when(_holds(F.lower(name), TEXT_HEADERS), 2.0).otherwise(0.0) + F.when(texts, 0.8).otherwise(0.0)


def _code_score(name: Column, codes: Column) -> Column:
    return F.when(_holds(F.lower(name), CODE_HEADERS), 2.0).otherwise(0.0) + F.when(codes, 1.2).otherwise(0.0)


def text_and_code(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, sheet, text_header, code_header of the sheets (doc_id, sheet, columns) that have a column of texts and another one of codes.

    By header and by the first ``SAMPLE`` of ``rows`` (doc_id, sheet, row, values); of equal scores the first column.
    """
    named = sheets.select("doc_id", "sheet", F.posexplode("columns").alias("at", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    named = named.groupBy("doc_id", "sheet", "name").agg(F.min("at").alias("at"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "sheet").orderBy("row"))).where(F.col("_n") <= SAMPLE)
    cells = _told(first.select("doc_id", "sheet", F.posexplode("values").alias("at", "value"))).groupBy("doc_id", "sheet", "at").agg(F.bool_or("is_code").alias("codes"), F.bool_or("is_text").alias("texts"))
    both = named.join(cells, ["doc_id", "sheet", "at"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    text, code = _text_score(F.col("name"), yes("texts")), _code_score(F.col("name"), yes("codes"))
    best = lambda score: F.max(F.struct(score.alias("score"), (-F.col("at")).alias("at"), "name"))
    found = both.groupBy("doc_id", "sheet").agg(best(text).alias("t"), best(code).alias("c"), F.count(F.lit(1)).alias("n"))
    good = (F.col("n") >= 2) & (F.col("t.name") != F.col("c.name")) & (F.col("t.score") >= 0.8) & (F.col("c.score") >= 1.2)
    return found.where(good).select("doc_id", "sheet", F.col("t.name").alias("text_header"), F.col("c.name").alias("code_header"))


def _pairs(rows: DataFrame) -> DataFrame:
    """doc_id, sheet, row, headers, text, code: the text and the code among the values of a row: the last code, and of the other texts the longest."""
    cells = _told(rows.select("doc_id", "sheet", "row", "text_header", "code_header", F.posexplode("values").alias("at", "value"))).where("value <> ''")
    whole = cells.groupBy("doc_id", "sheet", "row", "text_header", "code_header").agg(F.max_by("value", F.when(F.col("is_code"), F.col("at"))).alias("code"), F.collect_list(F.struct(F.length("value").alias("n"), "value", "made_up", "is_text")).alias("cells"))
    longest = whole.where("code is not null").withColumn("longest", F.array_max(F.filter("cells", lambda c: (c["value"] != F.col("code")) & ~c["made_up"])))
    return longest.where("longest.is_text").select("doc_id", "sheet", "row", "text_header", "code_header", F.col("longest.value").alias("text"), "code")


def continued(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, sheet, row, text_header, code_header, text, code: the tables of a document under the two columns of the first that has them.

    A table with both headers gives its rows where both are filled. Of any other one the text and the code of each row are taken, and of its header, which is
    then a row itself (row -1). A document needs two tables that give rows; of equal rows the first counts.
    """
    anchor = text_and_code(sheets, rows).groupBy("doc_id").agg(F.min(F.struct("sheet", "text_header", "code_header")).alias("a")).select("doc_id", "a.text_header", "a.code_header")
    known = sheets.join(anchor, "doc_id").withColumns({"t": F.array_position("columns", F.col("text_header")), "c": F.array_position("columns", F.col("code_header"))}).withColumn("direct", (F.col("t") > 0) & (F.col("c") > 0))
    names = ["doc_id", "sheet", "text_header", "code_header", "direct", "t", "c"]
    every = rows.join(known.select(*names), ["doc_id", "sheet"])
    cell = lambda at: F.get("values", (F.col(at) - 1).cast("int"))
    direct = every.where("direct").select("doc_id", "sheet", "row", "text_header", "code_header", cell("t").alias("text"), cell("c").alias("code")).where(V.visible(F.col("text")) & V.visible(F.col("code")))
    heads = known.where("not direct").select(*names, F.lit(-1).cast("long").alias("row"), F.col("columns").alias("values"))
    other = _pairs(every.where("not direct").select(*names, "row", "values").unionByName(heads))
    both = direct.unionByName(other)
    enough = both.groupBy("doc_id").agg(F.count_distinct("sheet").alias("n")).where("n >= 2").select("doc_id")
    first = Window.partitionBy("doc_id", "text", "code").orderBy("sheet", "row")
    return both.join(enough, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def without_headings(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` without those that head a section: a text that ends in a colon beside a code, in tables that have a column of either."""
    pair = sheets.join(text_and_code(sheets, rows), ["doc_id", "sheet"]).select("doc_id", "sheet", F.array_position("columns", F.col("text_header")).alias("t"), F.array_position("columns", F.col("code_header")).alias("c"))
    cell = lambda at: F.trim(F.coalesce(F.get("values", (F.col(at) - 1).cast("int")), F.lit("")))
    heads = F.coalesce(cell("t").endswith(":") & V.is_code(cell("c")), F.lit(False))
    return rows.join(pair, ["doc_id", "sheet"], "left").where(~heads).select(*rows.columns)


def continued_rows(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """``continued`` without rows that head a section: the merged table's own first rows say which column holds texts and which codes."""
    merged = continued(sheets, rows)
    order = Window.partitionBy("doc_id").orderBy("sheet", "row")
    told = _told(_told(merged.withColumn("t", F.col("text")), "t").withColumnsRenamed({"is_text": "t_text", "is_code": "t_code"}).withColumn("c", F.col("code")), "c").withColumn("at", F.row_number().over(order))
    some = lambda c: F.coalesce(F.bool_or(F.when(F.col("at") <= SAMPLE, F.col(c))).over(Window.partitionBy("doc_id")), F.lit(False))
    one, two = F.col("text_header"), F.col("code_header")
    told = told.withColumns({"tt": _text_score(one, some("t_text")), "tc": _code_score(one, some("t_code")), "ct": _text_score(two, some("is_text")), "cc": _code_score(two, some("is_code"))})
    # Of equal scores the first column, that of texts, is meant
    straight = (F.col("tt") >= F.col("ct")) & (F.col("cc") > F.col("tc")) & (F.col("tt") >= 0.8) & (F.col("cc") >= 1.2)
    swapped = (F.col("ct") > F.col("tt")) & (F.col("tc") >= F.col("cc")) & (F.col("ct") >= 0.8) & (F.col("tc") >= 1.2)
    heads = (straight & F.col("t").endswith(":") & F.col("is_code")) | (swapped & F.col("c").endswith(":") & F.col("t_code"))
    return told.where(~heads).select(*merged.columns)


def under_headers(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, row, header, text: each cell (table_id, row, pos, x, width, text) under the header (table_id, pos, x, width) whose middle is nearest to its own.

    Of equally near headers the first counts; cells under one header are joined in order, blank ones and those without an x go. A cell looks at
    the last header before it and the first one after it: both sides in one order, no pairs of all with all.
    """
    middle = F.col("x") + F.coalesce("width", F.lit(0.0)) / 2
    anchors = headers.where("x is not null").groupBy("table_id", middle.alias("at")).agg(F.min("pos").alias("header"))
    marks = anchors.select("table_id", "at", F.lit(0).alias("side"), F.struct("at", "header").alias("h"), *[F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("pos", "long"), ("text", "string"))])
    asked = cells.where("x is not null").withColumn("text", F.trim("text")).where("text <> ''").select("table_id", middle.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema["h"].dataType).alias("h"), "row", "pos", "text")
    order = Window.partitionBy("table_id").orderBy("at", "side")
    placed = marks.unionByName(asked).withColumns({"before": F.last("h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("h", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("distance"), F.col(f"{c}.header").alias("header")))
    found = placed.where("side = 1").select("table_id", "row", "pos", "text", F.least(near("before"), near("after"))["header"].alias("header")).where("header is not null")
    return found.groupBy("table_id", "row", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), " ").alias("text"))


def page_columns(lines: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """``lines`` (page_id, x0, ...) with ``column_id`` from 1: that of the nearest column's left edge, null without x0.

    Edges are found from left to right: a line over ``gap`` from the last edge begins a column. The fold over a page's distinct places holds its edges.
    """
    places = lines.where("x0 is not null").groupBy("page_id").agg(F.array_sort(F.collect_set("x0")).alias("xs"))
    step = lambda edges, x: F.when((F.size(edges) > 0) & (x - F.element_at(edges, -1) <= gap), edges).otherwise(F.concat(edges, F.array(x)))
    edges = places.select("page_id", F.aggregate("xs", F.array().cast("array<double>"), step).alias("edges"))
    nearest = F.array_min(F.transform("edges", lambda e, i: F.struct(F.abs(e - F.col("x0")).alias("distance"), (i + 1).alias("column"))))["column"]
    return lines.join(edges, "page_id", "left").withColumn("column_id", F.when(F.col("x0").isNotNull(), nearest)).drop("edges")


def section_groups(sections: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, section_id, title, group_ids: sections (doc_id, n, title, text) with the groups (doc_id, pos, group_id, question) whose question their text holds.

    A document of groups without a section has one, its body, with all of them. Sections are few (12 a document), so each looks for its document's questions.
    """
    titled = sections.select("doc_id", "n", T.clean(F.coalesce(F.col("title"), F.concat_ws(" ", F.lit("Section"), F.col("n").cast("string")))).alias("title"), T.clean(F.col("text")).alias("text")).where("title <> '' or text <> ''")
    asked = groups.select("doc_id", "pos", "group_id", T.phrase(F.col("question")).alias("said"))
    held = titled.withColumn("phrase", T.phrase(F.col("text"))).join(asked.where("said <> ''"), "doc_id").where(F.contains("phrase", "said"))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", "group_id"))), lambda g: g["group_id"]).alias(c)
    found = titled.join(held.groupBy("doc_id", "n").agg(ids("group_ids")), ["doc_id", "n"], "left")
    named = found.select("doc_id", F.concat(F.lit("section_"), F.col("n").cast("string")).alias("section_id"), "title", F.coalesce("group_ids", F.array().cast("array<string>")).alias("group_ids"))
    bare = asked.join(titled.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(ids("group_ids"))
    return named.unionByName(bare.select("doc_id", F.lit("section_form_root").alias("section_id"), F.lit("Form Body").alias("title"), "group_ids"))
