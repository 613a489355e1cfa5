"""Lines of a page as a form: marks joined to their texts, wrapped options put together, and groups that keep to their page and column.

Lines are (doc_id, pos, text, page, column_id, y, x); all but doc_id and pos can be null. What a line is, is worked out by Spark beforehand; the fold over
lines keeps an open group's place and its last option, not its options, and says for each line what it is to which group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import form_texts as T

# How far apart lines can be that belong together.
MARK_Y, MARK_X = 6.0, 256.0
WRAP_Y, WRAP_X = 14.0, 96.0
UNKNOWN = "Unknown question"


def _first(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (doc_id, page, mark, text, ...) sorted by mark and distance the nearest text of each mark that no mark before has taken."""
    now, done, used = None, None, set()
    for batch in batches:
        keep = []
        for k, (doc, page, mark, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if (doc, page) != now:
                now, done, used = (doc, page), None, set()
            if mark != done and text not in used:
                done = mark
                used.add(text)
                keep.append(k)
        yield batch.select([0, 2, 3]).take(pa.array(keep, pa.int64()))


def nearest_texts(lines: DataFrame) -> DataFrame:
    """doc_id, mark, text (both pos): marks that stand alone in a line and the nearest text after them, to the right, on the page and at about the height.

    A text belongs to one mark, that of the first in reading order (page, y, x). Lines meet by bands of MARK_Y of height: an equi-join, each mark in three bands.
    """
    plain = T.clean(F.col("text"))
    placed = lines.select("doc_id", "pos", F.coalesce("page", F.lit(-1)).alias("page"), _first("y").cast("double").alias("y"), _first("x").cast("double").alias("x"), plain.alias("text"), T.is_mark(plain).alias("marks"))
    placed = placed.withColumn("band", F.floor(F.col("y") / MARK_Y))
    marks = placed.where("marks").select("doc_id", "page", F.col("pos").alias("mark"), F.col("y").alias("my"), F.col("x").alias("mx"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    texts = placed.where("not marks and text <> ''").select("doc_id", "page", F.col("pos").alias("text"), "y", "x", "band")
    after = F.struct("y", "x", "text") > F.struct("my", "mx", "mark")
    near = marks.join(texts, ["doc_id", "page", "band"]).where(after & (F.abs(F.col("y") - F.col("my")) <= MARK_Y) & (F.col("x") - F.col("mx")).between(0, MARK_X))
    near = near.withColumn("distance", F.abs(F.col("y") - F.col("my")) + (F.col("x") - F.col("mx")) / 100)
    dealt = near.select("doc_id", "page", "mark", "text", "my", "mx", "distance", "y", "x").repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "my", "mx", "mark", "distance", "y", "x", "text")
    return dealt.mapInArrow(_taken, "doc_id long, mark long, text long")


def with_marks(lines: DataFrame) -> DataFrame:
    """Lines with marks put before their texts: the text's place, the lesser x, the text's column or else the mark's."""
    found = nearest_texts(lines)
    marks = lines.select("doc_id", F.col("pos").alias("mark"), T.clean(F.col("text")).alias("_mark"), F.col("column_id").alias("_column"), F.col("x").alias("_x"))
    joined = lines.join(found.join(marks, ["doc_id", "mark"]).withColumnRenamed("text", "pos"), ["doc_id", "pos"], "left")
    joined = joined.join(found.select("doc_id", F.col("mark").alias("pos")), ["doc_id", "pos"], "left_anti")
    text = F.when(F.col("_mark").isNull(), F.col("text")).otherwise(F.trim(F.concat_ws(" ", "_mark", "text")))
    return joined.select("doc_id", "pos", text.alias("text"), "page", F.coalesce("column_id", "_column").alias("column_id"), "y", F.least("x", "_x").alias("x"))


def in_columns(lines: DataFrame) -> list[Column]:
    return ["doc_id", _first("page"), _first("column_id"), _first("y"), _first("x"), "pos"]


def unwrapped(lines: DataFrame) -> DataFrame:
    """Lines in which options have their further lines behind them; blank lines go.

    A line goes on an option if all lines since have, if it is no option, answer, question or pair itself, and if it stands within WRAP_Y below and WRAP_X beside
    the option, in its page and column. The option a line could go on is the last one before it, so this is a window, not a fold.
    """
    plain = lines.withColumn("text", T.clean(F.col("text"))).withColumn("option", T.option(F.col("text")).isNotNull())
    opens = F.col("option") | T.is_option_start(F.col("text")) | T.is_question(F.col("text")) | T.pair(F.col("text")).isNotNull() | (F.col("text") == "")
    order = Window.partitionBy("doc_id").orderBy(*in_columns(lines)[1:])
    told = plain.withColumn("opens", opens).withColumn("part", F.count_if("option").over(order))
    within = Window.partitionBy("doc_id", "part").orderBy(*in_columns(lines)[1:])
    told = told.withColumn("h", F.first(F.struct("page", "column_id", "y", "x", "option")).over(within))
    far = lambda c, most, signed: F.coalesce((F.col(c) - F.col(f"h.{c}") if signed else F.abs(F.col(c) - F.col(f"h.{c}"))) > most, F.lit(False))
    fits = F.col("h.option") & ~F.col("opens") & F.col("page").eqNullSafe(F.col("h.page")) & F.coalesce(F.col("column_id") == F.col("h.column_id"), F.lit(True)) & ~far("y", WRAP_Y, True) & ~far("x", WRAP_X, False)
    goes_on = F.min(F.when(F.col("option"), True).otherwise(fits)).over(within) & ~F.col("option")
    heads = told.withColumn("goes_on", goes_on).withColumn("chain", F.count_if(~F.col("goes_on")).over(order))
    rows = heads.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(F.struct(_first("page").alias("p"), _first("column_id").alias("c"), _first("y").alias("y0"), _first("x").alias("x0"), "pos", "text"))).alias("texts"), F.first(F.when(~F.col("goes_on"), F.struct("pos", "page", "column_id", "y", "x")), ignorenulls=True).alias("l"))
    return rows.select("doc_id", "l.pos", F.array_join(F.transform("texts", lambda t: t["text"]), " ").alias("text"), "l.page", "l.column_id", "l.y", "l.x").where("text <> ''")


def _many(question: str) -> bool:
    said = " ".join(re.findall("[a-zа-я0-9]+", question.lower()))
    return any(words in said for words in T.MANY)


class _Group:
    """An open group: where it stands, what it asks, and its last option."""

    def __init__(self, number: int, question: str, line: dict):
        self.number, self.question, self.page, self.column, self.last = number, question, line["page"], line["column_id"], None

    def lists(self, line: dict) -> bool:
        """Whether a line without a mark is an option of the group."""
        column, own = line["column_id"], self.last["column_id"] if self.last else None
        if line["pair"] or line["heading"] or not 2 <= line["n"] <= 18 or (None not in (line["page"], self.page) and line["page"] != self.page):
            return False
        if None not in (own, column) and own != column:
            return False
        if None not in (column, self.column):
            if column != self.column:
                return True
            if own is None:
                return line["starts"]
        if line["asks"]:
            return False
        return _many(self.question) or line["answers"] or self.last is not None

    def goes_on(self, line: dict) -> bool:
        """Whether a line goes on the last option."""
        last = self.last
        if last is None:
            return False
        near = not line["asks"] and not line["pair"]
        near = near and all(last[c] is None or line[c] in (None, last[c]) for c in ("page", "column_id"))
        near = near and all(None in (last[c], line[c]) or abs(line[c] - last[c]) <= most for c, most in (("y", WRAP_Y), ("x", WRAP_X)))
        if near:
            return not (last["marker"] or "").strip() and not last["selected"] and not line["starts"]
        return _many(self.question) and line["fragment"]


FOLDED = ["doc_id", "pos", "page", "column_id", "y", "x", "text", "marker", "selected", "pair", "heading", "starts", "asks", "fragment", "answers", "n"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos, group, role) of lines in reading order; role: asks, lists, goes_on, or null for lines outside groups."""
    doc, group, number = object(), None, 0
    for batch in batches:
        out = []
        for line in (dict(zip(FOLDED, values, strict=True)) for values in zip(*(batch.column(c).to_pylist() for c in FOLDED), strict=True)):
            if line["doc_id"] != doc:
                doc, group, number = line["doc_id"], None, 0
            option = line["marker"] is not None or (group is not None and group.lists(line))
            if group is not None:
                other = lambda a, b: None not in (a, b) and a != b
                if other(group.page, line["page"]) or (other(group.column, line["column_id"]) and not option and not group.goes_on(line)):
                    group = None
            role = None
            if option:
                if group is None:
                    number += 1
                    group = _Group(number, UNKNOWN, line)
                group.last, role = line, "lists"
            elif group is not None and group.goes_on(line):
                role = "goes_on"
            elif line["asks"]:
                number += 1
                group, role = _Group(number, line["text"], line), "asks"
            elif group is not None and group.last is None:
                group.question, role = f"{group.question} {line['text']}".strip(), "asks"
            out.append((line["doc_id"], line["pos"], group.number if role else None, role))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "pos", "group", "role"])


def roles(lines: DataFrame) -> DataFrame:
    """doc_id, pos, group, role of the lines that belong to a group. Documents are dealt over tasks and read in order of page, column, y and x."""
    text = T.clean(F.col("text"))
    told = lines.select("doc_id", "pos", "page", "column_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), text.alias("text")).where("text <> ''").withColumn("words", T.tokens(F.col("text")))
    t, words, option = F.col("text"), F.col("words"), T.option(F.col("text"))
    flags = {
        "marker": option["marker"], "selected": F.coalesce(option["selected"], F.lit(False)), "pair": T.pair(t).isNotNull(), "heading": T.is_heading(t), "starts": T.is_option_start(t, words), "asks": T.is_question(t, words),
        "fragment": T.is_fragment(t), "n": F.size("words"), "answers": F.coalesce(F.get("words", F.lit(0)).isin("да", "нет", "yes", "no"), F.lit(False)) | t.contains("%") | t.rlike(r"\p{Nd}"),
    }
    dealt = told.withColumns(flags).select(*FOLDED).repartition("doc_id").sortWithinPartitions(*in_columns(lines))
    return dealt.mapInArrow(_grouped, "doc_id long, pos long, group int, role string").where("role is not null")


def line_groups(lines: DataFrame) -> DataFrame:
    """doc_id, pos, group_id, question, group_type and options (label, selected, marker) of the groups among lines."""
    placed = roles(lines).join(lines.withColumn("text", T.clean(F.col("text"))), ["doc_id", "pos"])
    order = [_first("page").alias("p"), _first("column_id").alias("c"), _first("y").alias("y0"), _first("x").alias("x0"), F.col("pos")]
    placed = placed.withColumn("o", F.when(F.col("role") == "lists", F.coalesce(T.option(F.col("text")), F.struct(F.col("text").alias("label"), F.lit(False).alias("selected"), F.lit("").alias("marker")))))
    group = Window.partitionBy("doc_id", "group").orderBy(*order)
    placed = placed.withColumn("nth", F.count_if(F.col("role") == "lists").over(group))
    said = F.struct(*order, F.coalesce(F.col("o.label"), F.col("text")).alias("said"))
    parts = placed.groupBy("doc_id", "group", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["said"]), " ").alias("said"), F.min(F.struct(*order, "text")).alias("first"), F.first("o", ignorenulls=True).alias("o"))
    groups = parts.groupBy("doc_id", "group").agg(
        F.min("first").alias("first"), F.first(F.when(F.col("nth") == 0, F.col("said")), ignorenulls=True).alias("asked"),
        F.array_sort(F.collect_list(F.when(F.col("nth") > 0, F.struct("nth", F.col("said").alias("label"), "o.selected", "o.marker")))).alias("options"),
    ).where(F.size("options") > 0)
    question = F.coalesce("asked", F.lit(UNKNOWN))
    chosen = F.size(F.filter("options", lambda o: o["selected"]))
    plain = F.transform("options", lambda o: F.struct(o["label"].alias("label"), o["selected"].alias("selected"), o["marker"].alias("marker")))
    return groups.select("doc_id", F.col("first.pos").alias("pos"), T.group_id(F.col("first.text"), F.lit("group")).alias("group_id"), question.alias("question"), T.group_type(question, chosen).alias("group_type"), plain.alias("options"))
