"""Text read off images: pieces of a line put together, the best reading of each text, tokens put right, and rows of a page.

Pieces are (doc_id, page, pos, x, y, width, height, text, confidence, weight); ``weight`` is that of the reading a piece comes from. Both folds go down a
document's pieces in order (page, y, x) and hold the last line only; what belongs together is then put together by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks, look-alike letters, misread digits, how far apart pieces of a line are, and what belongs to a window and not to its page.
MARKS = ["1", "I", "l", "|", "/", "\\", "■", "☑", "☒", "✓", "✔", "V", "v", "X", "x", "0", "O", "o", "□", "☐", "○", "◯"]
CYRILLIC, LATIN = "АВЕКМНОРСТУХаеорсухкмтв", "ABEKMHOPCTYXaeopcyxkmtb"
DIGITS = ("оОoOIl|Ss", "000011155")
NUMBERLIKE = r"^[0-9OoОоIlI|lSBs$.,:/-]+$"
DATE = r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}$"
FRAGMENT_Y, FRAGMENT_GAP, WORD_GAP, OVERLAP = 14.0, 48.0, 24.0, -4.0
ROW_Y, CELL_GAP = 12.0, 56.0
LEAST, LEAST_SHORT = 0.42, 0.6
TOP, BOTTOM = 0.12, 0.94
WINDOW_WORDS = ["chrome", "firefox", "safari", "edge", "вкладк", "поиск", "search", "назад", "поделиться", "share", "копировать"]


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))


def date_token(token: Column) -> Column:
    """A date of year, month, day with misread digits put right, as yyyy-mm-dd; NULL for anything else."""
    read = F.translate(F.translate(token, *DIGITS), "./", "--")
    part = lambda k: F.split(read, "-")[k].try_cast("int")
    fits = read.rlike(DATE) & part(1).between(1, 12) & part(2).between(1, 31) & part(0).between(1900, 2100)
    return F.when(fits, F.concat_ws("-", F.lpad(part(0).cast("string"), 4, "0"), F.lpad(part(1).cast("string"), 2, "0"), F.lpad(part(2).cast("string"), 2, "0")))


def one_alphabet(token: Column) -> Column:
    """A token of both alphabets in the one that has more of its letters, Cyrillic if as many."""
    cyrillic, latin = F.regexp_count(token, F.lit("[А-яЁё]")), F.regexp_count(token, F.lit("[A-Za-z]"))
    return F.when((cyrillic == 0) | (latin == 0), token).when(cyrillic >= latin, F.translate(token, LATIN, CYRILLIC)).otherwise(F.translate(token, CYRILLIC, LATIN))


def token(text: Column) -> Column:
    """A token put right: marks stay, dates and numbers get their digits, words one alphabet."""
    read = plain(text)
    one = one_alphabet(read)
    dated = F.when(read.rlike(r"[-./]"), date_token(read))
    return F.when(read.isin(MARKS), read).otherwise(F.coalesce(dated, F.when(one.rlike(NUMBERLIKE), F.translate(one, *DIGITS)).otherwise(one)))


def is_noise(text: Column) -> Column:
    """Whether a token says nothing: no letter or digit, or one or two characters that are no number and no mark."""
    short = (F.length(text) < 2) | ((F.length(text) <= 2) & ~text.rlike(r"^\p{Nd}+$"))
    return ~text.isin(MARKS) & ((text == "") | ~text.rlike(r"[\p{L}\p{N}]") | short)


def _folded(begin: Callable) -> Callable:
    """Rows (doc_id, pos, page, y, x, width, text) in order with ``run``: a new one where ``begin(held, row)`` gives what is held anew, not None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, number = object(), None, 0
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != doc:
                    doc, held, number = row[0], None, 0
                goes_on = held is not None and begin(held, row)
                if not goes_on:
                    number += 1
                    held = list(row)
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["doc_id", "pos", "run"])

    return run


def _same_line(held: list, row: tuple) -> bool:
    """Whether a piece goes on the held one, which then takes it in."""
    (_, _, page, y, x, width, text), (_, _, rpage, ry, rx, rwidth, rtext) = held, row
    if page != rpage or None in (y, ry, x, width, rx) or abs(y - ry) > FRAGMENT_Y or not text or not rtext:
        return False
    gap = rx - (x + width)
    close = text in MARKS or rtext in MARKS or len(text) <= 3 or len(rtext) <= 3 or gap <= WORD_GAP
    if not OVERLAP <= gap <= FRAGMENT_GAP or not close:
        return False
    right = max(x + width, rx + (rwidth or 0.0))
    held[3:] = [min(y, ry), min(x, rx), right - min(x, rx), f"{text} {rtext}"]
    return True


def _same_row(held: list, row: tuple) -> bool:
    return held[2] == row[2] and abs(held[3] - row[3]) <= ROW_Y


def _runs(pieces: DataFrame, begin: Callable) -> DataFrame:
    rows = pieces.select("doc_id", "pos", F.coalesce("page", F.lit(0)).alias("page"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("width").cast("double").alias("width"), plain(F.col("text")).alias("text"))
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", F.coalesce("y", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), "pos")
    return dealt.mapInArrow(_folded(begin), "doc_id long, pos long, run int")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces that stand in one line and close to each other as one: texts in order, the box around all, the best confidence, the first one's weight."""
    placed = pieces.join(_runs(pieces, _same_line), ["doc_id", "pos"]).withColumn("text", plain(F.col("text")))
    order = F.struct(F.coalesce("y", F.lit(0.0)), F.coalesce("x", F.lit(0.0)), "pos")
    whole = placed.groupBy("doc_id", "run").agg(
        F.min_by("pos", order).alias("pos"), F.min_by("weight", order).alias("weight"), F.first("page", ignorenulls=True).alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))), lambda t: t["text"]), " ").alias("text"),
        F.max("confidence").alias("confidence"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.coalesce("width", F.lit(0.0))) - F.min("x")).alias("width"), (F.max(F.col("y") + F.coalesce("height", F.lit(0.0))) - F.min("y")).alias("height"),
    )
    return whole.select(*[c for c in pieces.columns if c in whole.columns])


def is_worth_reading(text: Column, confidence: Column) -> Column:
    """Whether a text is sure enough: marks always; short ones need more; no single character over and over."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    short = (F.length(text) <= 2) | ((words <= 2) & (F.length(text) <= 8))
    over = (F.length(text) >= 3) & text.rlike(r"^(.)\1+$")
    sure = (confidence >= LEAST) & text.rlike(r"[\p{L}\p{N}]") & ~(short & (confidence < LEAST_SHORT)) & ~over
    return (text != "") & (text.isin(MARKS) | sure)


def is_window(text: Column, y: Column, height: Column, image: Column, screenshot: Column, repeats: Column) -> Column:
    """Whether a text belongs to the window around a page: addresses, words of a browser, repeated short texts, the top and bottom of a screenshot."""
    low = F.lower(text)
    words, length = F.size(F.filter(F.split(text, " "), lambda w: w != "")), F.length(text)
    hinted = F.lit(False)
    for word in WINDOW_WORDS:
        hinted = hinted | low.contains(word)
    top = F.coalesce((image > 0) & (y <= image * TOP), F.lit(False)) & (((words <= 6) & (text.contains(".") | text.contains(":") | (length <= 24))) | (F.regexp_count(text, F.lit(r"\p{Lu}")) >= F.greatest(F.lit(4), F.floor(length / 2))))
    bottom = F.coalesce((image > 0) & (y + height >= image * BOTTOM), F.lit(False)) & (words <= 5)
    repeated = (repeats > 1) & (words <= 3) & (length <= 24)
    return (text == "") | low.rlike(r"http://|https://|www\.") | (screenshot & (hinted | repeated | top | bottom))


def best_readings(pieces: DataFrame, images: DataFrame) -> DataFrame:
    """Of the joined pieces those worth reading, each text once but for case: the one of most confidence times weight, of equals the first.

    ``images``: doc_id, image_height, screenshot.
    """
    joined = joined_pieces(pieces).withColumn("key", F.lower("text")).withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "key")))
    placed = joined.join(images, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    window = is_window(F.col("text"), zero("y"), zero("height"), F.col("image_height"), F.coalesce("screenshot", F.lit(False)), F.col("repeats"))
    kept = placed.where(is_worth_reading(F.col("text"), zero("confidence")) & ~window).withColumn("s", zero("confidence") * F.coalesce("weight", F.lit(1.0)))
    first = Window.partitionBy("doc_id", "key").orderBy(F.desc("s"), F.coalesce("page", F.lit(0)), zero("y"), zero("x"), "pos")
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").select(*pieces.columns)


def page_rows(pieces: DataFrame) -> DataFrame:
    """doc_id, row, page, text, confidence: pieces within ROW_Y of the first of a row, from left to right, tokens put right, noise left out, and a bar where a gap parts cells."""
    known = pieces.where("y is not null")
    placed = known.join(_runs(known, _same_row), ["doc_id", "pos"]).withColumn("token", token(F.col("text")))
    said = placed.withColumn("right", F.when(F.col("x").isNotNull() & F.col("width").isNotNull(), F.col("x") + F.col("width"))).withColumn("noise", is_noise(F.col("token")))
    order = Window.partitionBy("doc_id", "run", "noise").orderBy(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0)), "pos")
    before = F.last("right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = F.coalesce(F.col("x") - before > CELL_GAP, F.lit(False))
    said = said.withColumn("said", F.when(~F.col("noise"), F.when(parted, F.concat(F.lit("| "), "token")).otherwise(F.col("token"))))
    said = said.withColumn("nth", F.row_number().over(order))
    rows = said.groupBy("doc_id", F.col("run").alias("row")).agg(
        F.first("page", ignorenulls=True).alias("page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("nth", "said")))), lambda t: t["said"]), " ").alias("text"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence")
    )
    return rows.where("text <> ''").withColumn("page", F.when(F.coalesce("page", F.lit(0)) == 0, 1).otherwise(F.col("page")))
