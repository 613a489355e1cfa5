"""Forms: labels with values, questions with options, and what a target field gets from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKER = r"^\s*(\[[ xXvVхХ✓]?\]|[☐☑☒✓✔■□])\s*(.+)$"
CHECKED = r"^\s*(\[[xXvVхХ✓]\]|[☑☒✓✔■])"


def option(line: Column) -> Column:
    """Struct label, selected, confidence of a line that begins with a box; NULL for other lines."""
    selected = line.rlike(CHECKED)
    return F.when(line.rlike(MARKER), F.struct(F.trim(F.regexp_extract(line, MARKER, 2)).alias("label"), selected.alias("selected"), F.when(selected, 0.96).otherwise(0.88).alias("confidence")))


def is_question(line: Column) -> Column:
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    return ~line.rlike(MARKER) & (line.endswith("?") | (line.endswith(":") & (words >= 2)))


UNKNOWN = "Unknown question"


def groups(lines: DataFrame) -> DataFrame:
    """doc_id, question, option, selected, confidence: every option under the nearest question above it, or under an unknown one.

    Without a fold: questions are counted up, and the count is the group. Plain lines between a question and its first option are part of it; later ones
    do not end the group.
    """
    marked = lines.withColumn("o", option(F.col("line"))).withColumn("q", is_question(F.col("line")))
    marked = marked.withColumn("group", F.count_if("q").over(Window.partitionBy("doc_id").orderBy("pos")))
    marked = marked.withColumn("first", F.min(F.when(F.col("o").isNotNull(), F.col("pos"))).over(Window.partitionBy("doc_id", "group")))
    asked = marked.where("o is null and pos < first").groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line")))).alias("parts"))
    asked = asked.where("group > 0").select("doc_id", "group", F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("question"))
    found = marked.where("o is not null").join(asked, ["doc_id", "group"], "left")
    return found.select("doc_id", F.coalesce("question", F.lit(UNKNOWN)).alias("question"), F.col("o.label").alias("option"), "o.selected", "o.confidence")


def answers(group: DataFrame, enums: dict[str, str]) -> DataFrame:
    """doc_id, question, kind, answer, confidence: one choice, several, none, or ambiguous where a choice has no known meaning.

    ``enums`` gives the meaning of an option's lower-case label.
    """
    table = F.create_map(*[F.lit(x) for pair in enums.items() for x in pair])
    per = group.groupBy("doc_id", "question").agg(
        F.count_if("selected").alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("selected"), F.try_element_at(table, F.lower("option"))))).alias("known"),
        F.count_if(F.col("selected") & F.try_element_at(table, F.lower("option")).isNull()).alias("unknown"),
    )
    kind = F.when(F.col("n") == 0, "not_found").when(F.col("unknown") > 0, "ambiguous").when(F.col("n") == 1, "single").otherwise("multi")
    confidence = F.when(F.col("n") == 0, 0.0).when(F.col("unknown") > 0, 0.45).when(F.col("n") == 1, 0.92).otherwise(0.9)
    return per.select("doc_id", "question", kind.alias("kind"), F.array_join("known", ",").alias("answer"), confidence.alias("confidence"))


def line_words(words: pd.DataFrame) -> pd.DataFrame:
    """One page's words as lines: a word joins the first line whose top is within 4 points; a line's top is its least so far."""
    words = words.sort_values(["top", "x0", "id"], kind="stable")
    lines: list[float] = []
    out = []
    for top in words["top"]:
        for k, have in enumerate(lines):
            if abs(top - have) <= 4:
                lines[k] = min(have, top)
                out.append(k)
                break
        else:
            lines.append(top)
            out.append(len(lines) - 1)
    return pd.DataFrame({"page": words["page"].to_numpy(), "id": words["id"].to_numpy(), "line": out})


def lines_of(words: DataFrame) -> DataFrame:
    """page, id, line of words (page, id, top, x0); each page is folded alone, since a line's top moves with its words."""
    return words.groupBy("page").applyInPandas(line_words, "page long, id long, line int")
