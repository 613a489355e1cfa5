"""The form in a document: scalars and groups out of its tables and lines, each once, and without what a group has consumed.

Rows of tables are (doc_id, table_idx, row_idx, cells, paragraphs): ``paragraphs`` holds the paragraphs of each cell. Lines are (doc_id, pos, text and any
of the columns of REF). What a row is does not depend on other rows, so rows are told apart first, and groups are runs of rows: windows, no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import form_texts as T

#: Where something stands in a document: any of these can be null
REF = ["page", "line_id", "block_id", "paragraph_idx", "table_idx", "row_idx", "cell_idx"]
UNKNOWN = "Unknown question"


def _ref(**given: Column) -> Column:
    return F.struct(*[given.get(c, F.lit(None)).cast("string" if c.endswith("_id") else "long").alias(c) for c in REF])


def _row_scalar(first: str, second: str, n: str, marked: str) -> Column:
    """Struct label, value of a row with two filled cells that are neither marks, options nor a question, and no heading; else NULL."""
    label, value = F.col(f"{first}.text"), F.col(f"{second}.text")
    fits = ~F.col(marked) & (T.phrase(label) != T.phrase(value)) & ~label.endswith("?") & ~F.col(f"{first}.asks") & ~T.is_heading_pair(label, value)
    fits = fits & F.col(f"{first}.option").isNull() & F.col(f"{second}.option").isNull() & (F.size(T.tokens(label)) <= 8) & (F.length(value) <= 180)
    return F.when((F.col(n) == 2) & fits, F.struct(label.alias("label"), value.alias("value")))


def _bare_digit(text: Column) -> Column:
    return text.isin("0", "1")


def _by_row(cells: DataFrame, digits: bool = True) -> DataFrame:
    """Rows (doc_id, table_idx, row_idx) out of their cells (and cell_idx, text): how many are filled, the first two, marks, the first question, all texts.

    Cells are told apart as rows, not within arrays: what one of them is, is worked out once.
    """
    told = cells.withColumn("words", T.tokens(F.col("text"))).where("text <> ''")
    marks = T.is_mark(F.col("text")) if digits else T.is_mark(F.col("text")) & ~_bare_digit(F.col("text"))
    cell = F.struct("cell_idx", "text", marks.alias("marks"), T.is_question(F.col("text"), F.col("words")).alias("asks"), T.option(F.col("text")).alias("option"))
    told = told.select("doc_id", "table_idx", "row_idx", cell.alias("c"))
    row = told.groupBy("doc_id", "table_idx", "row_idx").agg(F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["cell_idx"] < b["cell_idx"], -1).otherwise(1)).alias("cs"))
    texts = lambda keep: F.array_join(F.transform(F.filter("cs", keep), lambda c: c["text"]), " ")
    first = lambda keep: F.get(F.filter("cs", keep), F.lit(0))
    return row.select(
        "doc_id", "table_idx", "row_idx", F.size("cs").alias("filled"), F.get("cs", F.lit(0)).alias("one"), F.get("cs", F.lit(1)).alias("two"), F.exists("cs", lambda c: c["marks"]).alias("marked"),
        first(lambda c: c["marks"])["text"].alias("marker"), texts(lambda c: ~c["marks"]).alias("beside"), first(lambda c: c["asks"]).alias("asking"), texts(lambda c: F.lit(True)).alias("text"),
    )


def _once(options: DataFrame) -> DataFrame:
    """Options that are the first of their phrase, and have one."""
    said = options.withColumn("phrases", F.transform("options", lambda o: T.phrase(o["label"])))
    return said.withColumn("options", F.filter("options", lambda o, i: (F.get("phrases", i) != "") & (F.array_position("phrases", F.get("phrases", i)) == i + 1))).drop("phrases")


def _with_lists(rows: DataFrame, digits: bool = True) -> DataFrame:
    """Rows with ``inline`` (question, cell_idx, options): one that asks in one cell and lists options in the next filled one; else NULL.

    The list is several paragraphs, parts with a semicolon, or has a mark; equal options count once.
    """
    lists = F.when(F.col("one.cell_idx") == F.col("asking.cell_idx"), F.col("two")).otherwise(F.col("one"))
    rows = rows.withColumn("list", F.when((F.col("filled") >= 2) & F.col("asking").isNotNull(), lists))
    rows = rows.withColumn("given", F.coalesce(F.get("paragraphs", F.col("list.cell_idx")), F.array().cast("array<string>")))
    marked = T.has_mark(F.col("list.text")) if digits else T.has_mark(F.col("list.text")) & ~_bare_digit(F.col("list.text"))
    several = (F.size("given") > 1) | F.col("list.text").contains(";") | marked
    bare = lambda x: F.trim(F.regexp_replace(x, ";+$", ""))
    lines = F.when(several, F.filter(F.transform(F.when(F.size("given") > 0, F.col("given")).otherwise(F.array("list.text")), lambda x: bare(T.clean(x))), lambda x: x != ""))
    rows = rows.withColumn("lines", F.coalesce(lines, F.array().cast("array<string>"))).withColumn("read", F.transform("lines", T.option))
    option = lambda o, i: F.struct(F.coalesce(bare(o["label"]), F.get("lines", i)).alias("label"), F.coalesce(o["selected"], F.lit(False)).alias("selected"), F.coalesce(o["marker"], F.lit("")).alias("marker"))
    rows = _once(rows.withColumn("options", F.transform("read", option)))
    inline = F.struct(F.col("asking.text").alias("question"), F.col("asking.cell_idx").alias("cell_idx"), "options")
    return rows.withColumn("inline", F.when(F.size("options") > 0, inline)).drop("list", "given", "lines", "read")


def read_rows(rows: DataFrame, digits: bool = True) -> DataFrame:
    """Rows with ``kind`` (inline, scalar, option, question, text; blank rows go) and what they say. Rows of a table stay together from here on.

    A cell that is 0 or 1 and nothing else is a mark, but not (``digits`` false) where the tables' values are numbers: there it is a value like 2.
    """
    kept = F.transform("paragraphs", lambda p: F.filter(F.transform(p, T.clean), lambda x: x != ""))
    dealt = rows.repartition("doc_id", "table_idx")
    cells = dealt.select("doc_id", "table_idx", "row_idx", F.posexplode("cells").alias("cell_idx", "text")).withColumn("text", T.clean(F.col("text")))
    told = _by_row(cells, digits).join(dealt.select("doc_id", "table_idx", "row_idx", kept.alias("paragraphs")), ["doc_id", "table_idx", "row_idx"])
    told = _with_lists(told, digits)
    option = F.when(F.col("marker").isNotNull() & (F.length("beside") >= 2), F.struct(F.col("beside").alias("label"), T.is_checked(F.col("marker")).alias("selected"), "marker"))
    told = told.withColumns({"scalar": _row_scalar("one", "two", "filled", "marked"), "option": option, "question": T.is_question(F.col("text"))})
    kind = F.when(F.col("inline").isNotNull(), "inline").when(F.col("scalar").isNotNull(), "scalar").when(F.col("option").isNotNull(), "option")
    return told.withColumn("kind", kind.when(F.col("question"), "question").otherwise("text")).select("doc_id", "table_idx", "row_idx", "text", "kind", "inline", "scalar", "option", "options")


def table_scalars(rows: DataFrame, digits: bool = True) -> DataFrame:
    """doc_id, pos, label, value, confidence, source, ref of the rows that hold a label and a value; ``digits`` as of ``read_rows``."""
    found = read_rows(rows, digits).where("kind = 'scalar'")
    ref = _ref(table_idx=F.col("table_idx"), row_idx=F.col("row_idx"))
    return found.select("doc_id", (F.col("table_idx") * 1_000_000 + F.col("row_idx")).cast("long").alias("pos"), "scalar.label", "scalar.value", F.lit("medium").alias("confidence"), F.lit("table_cell").alias("source"), ref.alias("ref"))


def table_groups(rows: DataFrame, digits: bool = True) -> DataFrame:
    """doc_id, group_id, question, group_type, ref and options (label, selected, marker, ref) of the groups in tables.

    A question row opens a group, text rows before its first option go on with the question, an inline row is a group of its own and ends the one before.
    A scalar row ends a group that has options; options without a group are under an unknown question. ``digits`` as of ``read_rows``.
    """
    told = read_rows(rows, digits)
    order = Window.partitionBy("doc_id", "table_idx").orderBy("row_idx")
    told = told.withColumn("part", F.count_if(F.col("kind").isin("question", "inline")).over(order))
    within = Window.partitionBy("doc_id", "table_idx", "part").orderBy("row_idx")
    # A scalar right after an option (but for texts) closes what is open.
    last = F.last(F.when(F.col("kind").isin("option", "scalar"), F.col("kind")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("closes", (F.col("kind") == "scalar") & F.coalesce(last == "option", F.lit(False))).withColumn("nth", F.count_if("closes").over(within))
    told = told.withColumn("begun", F.count_if(F.col("kind") == "option").over(within) > 0)
    asks = F.col("kind").isin("question", "text") & (F.col("nth") == 0) & ~F.col("begun")
    at = _ref(table_idx=F.col("table_idx"), row_idx=F.col("row_idx"))
    parts = told.groupBy("doc_id", "table_idx", "part", "nth").agg(
        F.array_sort(F.collect_list(F.when(asks, F.struct("row_idx", "kind", "text")))).alias("asked"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "option", F.struct("row_idx", "option.label", "option.selected", "option.marker", at.alias("ref"))))).alias("run"),
        F.first(F.when(F.col("kind") == "inline", F.struct("row_idx", "inline.question", "inline.cell_idx", F.transform("options", lambda o: F.struct(o["label"].alias("label"), o["selected"].alias("selected"), o["marker"].alias("marker"), at.alias("ref"))).alias("options"))), ignorenulls=True).alias("inline"),
    )
    opens = F.get("asked", F.lit(0))
    parts = parts.withColumns({"question": F.when(opens["kind"] == "question", F.array_join(F.transform("asked", lambda x: x["text"]), " ")), "row": F.when(opens["kind"] == "question", opens["row_idx"]).otherwise(F.get("run", F.lit(0))["row_idx"])})
    plain = F.transform("run", lambda o: F.struct(o["label"].alias("label"), o["selected"].alias("selected"), o["marker"].alias("marker"), o["ref"].alias("ref")))
    run = F.when(F.size("run") > 0, F.struct("row", "question", F.lit(None).cast("int").alias("cell_idx"), plain.alias("options")))
    one = F.when(F.col("inline").isNotNull(), F.struct(F.col("inline.row_idx").alias("row"), "inline.question", "inline.cell_idx", "inline.options"))
    found = parts.select("doc_id", "table_idx", F.explode(F.array_compact(F.array(run, one))).alias("g")).select("doc_id", "table_idx", "g.*")
    named = F.concat_ws("_", F.lit("group"), F.col("table_idx").cast("string"), F.col("row").cast("string"))
    fatca = F.col("cell_idx").isNotNull() & F.exists("options", lambda o: T.phrase(o["label"]).contains("fatca"))
    group_id = F.when(F.col("question").isNull(), named).when(fatca, "fatca_beneficiary").otherwise(T.group_id(F.col("question"), named))
    chosen = F.size(F.filter("options", lambda o: o["selected"]))
    asked = F.coalesce("question", F.lit(UNKNOWN))
    ref = _ref(table_idx=F.col("table_idx"), row_idx=F.col("row"), cell_idx=F.col("cell_idx"))
    return found.select("doc_id", (F.col("table_idx") * 1_000_000 + F.col("row")).cast("long").alias("pos"), group_id.alias("group_id"), asked.alias("question"), T.group_type(asked, chosen).alias("group_type"), ref.alias("ref"), "options")


def line_scalars(lines: DataFrame) -> DataFrame:
    """doc_id, pos, label, value, confidence, source, ref: lines with a colon, and rows put together from cells that stand as lines of their own."""
    at = F.struct(*REF)
    pairs = lines.withColumn("p", T.pair(F.col("text"))).where("p is not null").select("doc_id", "pos", "p.label", "p.value", F.lit("high").alias("confidence"), "source", at.alias("ref"))
    cells = lines.where("source = 'table_cell' and table_idx is not null and row_idx is not null and cell_idx is not null").withColumn("text", T.clean(F.col("text"))).where("text <> ''")
    cells = cells.groupBy("doc_id", "table_idx", "row_idx", "cell_idx").agg(F.max_by("text", "pos").alias("text"))  # of equal places the last line counts
    found = _by_row(cells).withColumn("s", _row_scalar("one", "two", "filled", "marked")).where("s is not null")
    ref = _ref(table_idx=F.col("table_idx"), row_idx=F.col("row_idx"))
    return pairs.unionByName(found.select("doc_id", (F.lit(1 << 40) + F.col("table_idx") * 1_000_000 + F.col("row_idx")).alias("pos"), "s.label", "s.value", F.lit("medium").alias("confidence"), F.lit("table_cell").alias("source"), ref.alias("ref")))


def distinct_scalars(*parts: DataFrame) -> DataFrame:
    """Scalars of several sources, the first of those that agree in the words of the label and in the value but for case; headings and blanks go."""
    every = parts[0].withColumn("rank", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("rank", F.lit(k)))
    plain = every.withColumns({"label": F.trim("label"), "value": F.trim("value")}).where("label <> '' and value <> ''")
    first = Window.partitionBy("doc_id", T.phrase(F.col("label")), F.lower("value")).orderBy("rank", "pos")
    once = plain.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return once.where((T.clean(F.col("label")) != "") & (T.clean(F.col("value")) != "") & ~T.is_heading_pair(T.clean(F.col("label")), T.clean(F.col("value"))))


def distinct_groups(groups: DataFrame) -> DataFrame:
    """The first of the groups that agree in the words of question and options; groups without either go."""
    said = groups.where((F.trim("question") != "") & (F.size("options") > 0)).withColumn("key", F.xxhash64(T.phrase(F.col("question")), F.transform("options", lambda o: T.phrase(o["label"]))))
    first = Window.partitionBy("doc_id", "key").orderBy("pos", "group_id", "question")
    return said.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "key")


def _ref_keys(ref: str, asking: bool) -> Column:
    """What two references must share to overlap, as strings: overlap is a common key, so it is found by an equi-join.

    A line, block, paragraph or cell is the same if it has the same number, and the same row of a table where both name one, or else the same page where
    both name one; rows of tables are the same by table and row. A side that names no row or page meets any on the other side: what holds the
    groups (not ``asking``) gives its keys with and without them.
    """
    r = F.col(ref)
    row, page = F.concat_ws("/", r["table_idx"].cast("string"), r["row_idx"].cast("string")), r["page"].cast("string")
    has_row, has_page = r["table_idx"].isNotNull() & r["row_idx"].isNotNull(), r["page"].isNotNull()
    out = [F.when(has_row, F.concat(F.lit("row "), row))]
    for c in ("line_id", "block_id", "paragraph_idx", "cell_idx"):
        it = F.concat(F.lit(f"{c} "), r[c].cast("string"))
        with_row, with_page, no_page = F.concat(it, F.lit(" row "), row), F.concat(it, F.lit(" page "), page), F.concat(it, F.lit(" page -"))
        no_row = lambda x: F.concat(x, F.lit(" row -"))
        if asking:
            out.append(F.when(has_row, with_row))
            for mine, key in ((has_row, no_row), (~has_row, lambda x: x)):
                out += [F.when(mine & has_page, key(with_page)), F.when(mine & has_page, key(no_page)), F.when(mine & ~has_page, key(it))]
        else:
            out.append(F.when(has_row, with_row))
            for mine, key in ((~has_row, no_row), (F.lit(True), lambda x: x)):
                out += [F.when(mine & has_page, key(with_page)), F.when(mine & ~has_page, key(no_page)), F.when(mine, key(it))]
    return F.array_compact(F.array(*out))


def unconsumed(scalars: DataFrame, groups: DataFrame) -> DataFrame:
    """Scalars that no group of their document has consumed: not at a place of a group or an option, and not in the words of a question or option."""
    said = lambda c: F.concat(F.lit("says "), T.phrase(c))
    options = groups.select("doc_id", F.explode("options").alias("o"))
    taken = groups.select("doc_id", F.explode(F.concat(_ref_keys("ref", False), F.array(said(F.col("question"))))).alias("key"))
    taken = taken.unionByName(options.select("doc_id", F.explode(F.concat(_ref_keys("o.ref", False), F.array(said(F.col("o.label"))))).alias("key"))).where("key <> 'says '").distinct()
    asked = scalars.withColumn("_id", F.xxhash64("label", "value", "rank", "pos"))
    keys = asked.select("doc_id", "_id", F.explode(F.array_distinct(F.concat(_ref_keys("ref", True), F.array(said(F.col("label")), said(F.col("value")))))).alias("key"))
    gone = keys.join(taken, ["doc_id", "key"], "left_semi").select("doc_id", "_id").distinct()
    return asked.join(gone, ["doc_id", "_id"], "left_anti").drop("_id")


def scored_scalars(scalars: DataFrame) -> DataFrame:
    """Scalars with the score of their source and of their confidence."""
    base = F.when(F.col("source") == "table_cell", 0.88).when(F.col("source") == "paragraph", 0.7).when(F.col("source") == "line", 0.74).otherwise(0.72)
    score = F.when(F.col("confidence") == "high", F.greatest(base, F.lit(0.85))).when(F.col("confidence") == "low", F.least(base, F.lit(0.58))).otherwise(base)
    return scalars.withColumn("score", score)


def scored_groups(groups: DataFrame) -> DataFrame:
    """Groups with the scores of the group and of the choice, and whether several options of a single choice are selected."""
    chosen = F.filter("options", lambda o: o["selected"])
    marked = F.exists("options", lambda o: F.trim(o["marker"]) != "")
    torn = (F.col("group_type") == "single_choice") & (F.size(chosen) > 1)
    score = F.lit(0.5) + F.when(F.trim("question") != "", 0.15).otherwise(0.0) + F.when(F.size("options") >= 2, 0.15).otherwise(0.0) + F.when(marked, 0.15).otherwise(0.0) - F.when(torn, 0.15).otherwise(0.0)
    pick = F.when(F.size(chosen) == 1, F.when(F.trim(F.get(chosen, F.lit(0))["marker"]) != "", 0.95).otherwise(0.7)).when(F.size(chosen) > 1, 0.25).otherwise(F.when(F.size("options") > 0, 0.35).otherwise(0.0))
    return groups.withColumns({"group_score": F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(0.99)), 4), "choice_score": pick, "ambiguous": torn})


#: Labels that are a mark rather than a name
MARK_LABELS = ["x", "[x]", "v", "[v]", "✓", "✔", "☒", "☑", "да", "нет", "yes", "no"]


def without_fragments(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (doc_id, label, value) of a document's text that are no pieces of its groups: none holds an option's text, or a question's if the label is a mark.

    A document's pairs are few (32 and 16 at most), so each is looked through for all texts of the document's groups.
    """
    plain = lambda c: F.lower(T.clean(c))
    said = groups.select("doc_id", plain(F.col("question")).alias("q"), F.transform("options", lambda o: plain(o["label"])).alias("os"))
    texts = said.groupBy("doc_id").agg(F.array_compact(F.collect_set(F.nullif("q", F.lit("")))).alias("asked"), F.filter(F.array_distinct(F.flatten(F.collect_list("os"))), lambda x: x != "").alias("listed"))
    label = plain(F.col("label"))
    whole = F.trim(F.concat_ws(" ", label, plain(F.col("value"))))
    both = pairs.join(texts, "doc_id", "left").withColumn("_whole", whole)
    holds = lambda c: F.coalesce(F.exists(c, lambda x: F.contains("_whole", x)), F.lit(False))
    gone = (F.col("_whole") != "") & (holds("listed") | (label.isin(MARK_LABELS) & holds("asked")))
    return both.where(~gone).drop("asked", "listed", "_whole")
