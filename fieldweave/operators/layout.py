"""Lines, zones and segments of pages: windows where order alone decides, a fold per page where decisions feed decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import texts as T

GAP, SEGMENT_GAP = 26.0, 60.0


def regions(lines: DataFrame, page: str, y: str, gap: float = GAP) -> DataFrame:
    """``lines`` with ``region``: a new one where the step down from the line before is over ``gap``."""
    w = Window.partitionBy(page).orderBy(y)
    return lines.withColumn("region", F.coalesce(F.sum(F.when(F.col(y) - F.lag(y).over(w) > gap, 1).otherwise(0)).over(w), F.lit(0)))


def region_zones(lines: DataFrame, page: str) -> DataFrame:
    """Each region's zone, score and number of lines, from its lines (page, region, zone, text, words).

    noise if all lines but one at most are noise, form if half of them are, else text; a short one with a heading's word is noise.
    """
    n = lines.groupBy(page, "region").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("zone") == "noise").alias("noise"), F.count_if(F.col("zone") == "form").alias("form"), F.avg("words").alias("mean"), F.bool_or(T.has_any(F.lower("text"), T.HEADING_WORDS)).alias("headed")
    )
    least = lambda x: F.greatest(F.lit(1), x)
    verdict = lambda z, score: F.struct(F.lit(z).alias("zone"), F.lit(score).alias("score"))
    found = (
        F.when(F.col("noise") >= least(F.col("lines") - 1), verdict("noise", 0.86))
        .when(F.col("form") >= least(F.floor(F.col("lines") / 2)), verdict("form", 0.8))
        .when((F.col("mean") >= 9) | (F.col("lines") >= 3), verdict("text", 0.74))
        .when(F.col("headed"), verdict("noise", 0.78))
        .otherwise(verdict("text", 0.58))
    )
    return n.select(page, "region", found.alias("v"), "lines").select(page, "region", "v.zone", "v.score", "lines")


def page_class(zones: DataFrame, page: str) -> DataFrame:
    """Each page's kind from its zones (page, zone): counts, the dominant zone (of equal counts table, form, text, noise) and the content type."""
    n = lambda z: F.count_if(F.col("zone") == z).alias(f"n_{z}")
    counts = zones.groupBy(page).agg(*[n(z) for z in ("table", "form", "text", "noise")])
    order = F.array(*[F.struct(F.col(f"n_{z}").alias("n"), F.lit(-k).alias("k"), F.lit(z).alias("z")) for k, z in enumerate(("table", "form", "text", "noise"))])
    content = F.when((F.col("n_table") > 0) & (F.col("n_form") + F.col("n_text") > 0), "mixed").when(F.col("n_table") > 0, "table").when(F.col("n_form") > 0, "form").otherwise("text")
    return counts.withColumn("dominant", F.array_max(order)["z"]).withColumn("content_type", content)


def segments(documents: DataFrame, gap: float = SEGMENT_GAP) -> DataFrame:
    """doc_id, line, segment, x0, x1, n_words: runs of a line's words without a gap over ``gap`` between them.

    A character is 7 points wide, so a gap is a run of blanks. Lines are cut before such runs within the row: no shuffle.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content")).where(F.trim("content") != "")
    marked = F.regexp_replace("content", rf" {{{int(gap // 7) + 1},}}", "\x01$0")
    cut = lines.select("doc_id", "line", F.split(marked, "\x01").alias("parts"))
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda n, p: n + F.length(p))
    placed = F.transform("parts", lambda p, i: F.struct(before(i).alias("at"), p.alias("p")))
    parts = F.filter(placed, lambda x: F.trim(x["p"]) != "")
    each = cut.select("doc_id", "line", F.posexplode(parts).alias("segment", "s"))
    x0 = F.col("s.at") + F.length("s.p") - F.length(F.ltrim(F.col("s.p")))
    words = F.size(F.filter(F.split("s.p", " "), lambda w: w != ""))
    return each.select("doc_id", "line", F.col("segment").cast("long").alias("segment"), (x0 * 7.0).alias("x0"), ((F.col("s.at") + F.length(F.rtrim(F.col("s.p")))) * 7.0).alias("x1"), words.cast("long").alias("n_words"))


def row_bands(blocks: DataFrame) -> DataFrame:
    """page, id, band: a block joins the first band whose running mean height is near; the mean moves with it.

    The mean depends on what joined before, so each page is folded in order of y; pages are the parallel axis.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x", "id"], kind="stable")
        bands: list[list[float]] = []
        out = []
        for y, h in zip(page["y"], page["height"], strict=True):
            for k, (mean, n, height) in enumerate(bands):
                if abs(y - mean) <= max(8.0, min(0.55 * (h + height), 18.0)):
                    bands[k] = [(mean * n + y) / (n + 1), n + 1, max(height, h)]
                    out.append(k)
                    break
            else:
                bands.append([y, 1, h])
                out.append(len(bands) - 1)
        return pd.DataFrame({"page": page["page"].to_numpy(), "id": page["id"].to_numpy(), "band": out})

    return blocks.groupBy("page").applyInPandas(fold, "page long, id long, band int")
