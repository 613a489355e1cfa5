"""Previews, tables, groups, zones and events as a reviewer sees them: usability, order, counts, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions import texts as T
from fieldweave.functions import values as V


def expected_sources(mappings: DataFrame) -> DataFrame:
    """case_id and the distinct filled sources of its mappings (case_id, pos, source), in their order."""
    named = mappings.where(V.visible(F.col("source"))).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("source").alias("source")))).alias("m"))
    return named.select("case_id", F.array_distinct(F.transform("m", lambda x: x["source"])).alias("sources"))


def usable_previews(rows: DataFrame, columns: list[str], first: int = 5) -> DataFrame:
    """table and usable: two columns or more, and among the first rows one with two filled cells or more (rows: table, pos, columns)."""
    filled = sum((F.when(V.visible(F.col(c).cast("string")), 1).otherwise(0) for c in columns), F.lit(0))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("table").orderBy("pos")))
    return ranked.groupBy("table").agg((F.max(F.when(F.col("n") <= first, (filled >= 2).cast("int"))) == 1).alias("usable")).withColumn("usable", F.col("usable") & F.lit(len(columns) >= 2))


def found_events(events: DataFrame, stage: str | None, text: str) -> DataFrame:
    """Events (stage, title, description) of a stage (None: any) whose title or description holds the text, case aside; blank text holds everywhere."""
    hay = F.lower(F.concat_ws(" ", "title", "description"))
    return events.where((F.lit(True) if stage is None else F.col("stage") == stage) & F.contains(hay, F.lit(text.strip().lower())))


def stage_counts(events: DataFrame, stages: list[str]) -> DataFrame:
    """One row: all events and those of each stage."""
    return events.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("stage") == s).alias(s) for s in stages])


def zone_edges(zones: DataFrame) -> DataFrame:
    """page, from_zone, to_zone, relation: each zone to the next of its column; a column's last zone to every zone of later columns of its page."""
    by = Window.partitionBy("page", "column_id").orderBy("y", "zone_id")
    placed = zones.withColumn("next", F.lead("zone_id").over(by))
    down = placed.where("next is not null").select("page", F.col("zone_id").alias("from_zone"), F.col("next").alias("to_zone"), F.lit("next_in_column").alias("relation"))
    last = placed.where("next is null").select("page", F.col("zone_id").alias("from_zone"), F.col("column_id").alias("own"))
    across = last.join(zones.select("page", F.col("zone_id").alias("to_zone"), "column_id"), "page").where("column_id > own")
    return down.unionByName(across.select("page", "from_zone", "to_zone", F.lit("adjacent_column").alias("relation")))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with their place in reading order: page, column, height, then from the left; what is unknown comes first."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(zero("page"), zero("column_id"), zero("y"), zero("x"), "line_id")))


def united_sheets(tables: DataFrame) -> DataFrame:
    """book, columns (in order of first use), rows and a warning, over the sheets (book, sheet, pos, columns, rows) of each workbook that are not empty."""
    full = tables.groupBy("book").agg(F.count(F.lit(1)).alias("sheets"), F.array_sort(F.collect_list(F.when(F.col("rows") > 0, F.struct("pos", "sheet", "columns", "rows")))).alias("full"))
    names = F.transform("full", lambda s: s["sheet"])
    columns = F.array_distinct(F.flatten(F.transform("full", lambda s: s["columns"])))
    rows = F.aggregate("full", F.lit(0).cast("long"), lambda n, s: n + s["rows"])
    many, only = F.size("full") > 1, (F.size("full") == 1) & (F.col("sheets") > 1)
    warning = F.when(many, F.concat(F.lit("Merged "), F.size("full").cast("string"), F.lit(" sheets: "), F.array_join(names, ", "))).when(only, F.concat(F.lit("Workbook has multiple sheets. Used the only non-empty sheet: "), F.get(names, F.lit(0))))
    return full.select("book", columns.alias("columns"), rows.alias("rows"), warning.alias("warning"))


def routing_adjustment(mappings: DataFrame) -> DataFrame:
    """case_id, adjusted, reasons, targets and the strongest penalty of mappings (case_id, target, reason, penalty) whose confidence was lowered."""
    low = mappings.where(F.col("reason").isNotNull() & (F.col("reason") != ""))
    return low.groupBy("case_id").agg(F.count(F.lit(1)).alias("adjusted"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.count_distinct("target").alias("targets"), F.max("penalty").alias("strongest"))


def group_signals(groups: DataFrame, least_group: float = 0.6, least_selection: float = 0.6) -> DataFrame:
    """doc_id with its ambiguous groups and those of low confidence, each listed once; an ambiguous group is not listed as low."""
    low = ~F.col("ambiguous") & ((F.col("group_confidence") < least_group) | (F.col("selection_confidence") < least_selection))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.trim("group_id")))), ",")
    return groups.where(V.visible(F.col("group_id"))).groupBy("doc_id").agg(named(F.col("ambiguous")).alias("ambiguous_groups"), named(F.coalesce(low, F.lit(False))).alias("low_confidence_groups"))


MARKS = ["☒", "☑", "✓", "✔", "X", "x", "V", "v", "[X]", "[x]"]


def table_zones(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """table, zone and score from cells (table, row, col, value) and headers (table, names): a data table, a form laid out as one, or noise.

    Data: two rows, most rows filled, cells filled, short headers that ask nothing. Form: check marks, gaps, questions above, short cells.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    marked = value.isin(MARKS) | value.rlike(r"^(?:X |x |\[X\]|\[x\])")
    n = F.size("names")
    rows = cells.join(headers, "table").groupBy("table", "row", n.alias("n")).agg(F.count_if(value != "").alias("filled"), F.count_if(marked).alias("marks"), F.count_if((value != "") & (T.word_count(value) <= 3)).alias("short"))
    t = rows.groupBy("table", "n").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("filled") / F.col("n")).alias("fill"), F.sum("marks").alias("marks"), F.sum("short").alias("short"), F.count_if(F.col("filled") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).alias("full")).join(headers, "table")
    asks = T.has_any(F.lower(F.array_join("names", " ")), T.QUESTION_MARKS)
    brief = F.size(F.filter("names", lambda x: T.word_count(x) <= 3)) >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    points = lambda *of: sum((F.when(c, p).otherwise(0.0) for c, p in of), F.lit(0.0))
    data = points((F.col("rows") >= 2, 0.25), (F.col("full") >= F.greatest(F.lit(2), F.floor(F.col("rows") / 2)), 0.25), (F.col("fill") >= 0.55, 0.2), (brief & ~asks, 0.15))
    form = points((F.col("marks") > 0, 0.35), (F.col("fill") <= 0.6, 0.2), (asks, 0.2), (F.col("short") >= F.greatest(F.lit(4), F.col("rows")), 0.15))
    scored = t.withColumn("data", data).withColumn("form", form)
    zone = F.when((F.col("form") >= F.col("data")) & (F.col("form") >= 0.35), "form").when(F.col("data") >= 0.35, "table").otherwise("noise")
    return scored.select("table", zone.alias("zone"), F.round(F.when(zone == "form", F.col("form")).when(zone == "table", F.col("data")).otherwise(F.greatest("data", "form", F.lit(0.1))), 4).alias("score"))


def model_usage(responses: DataFrame) -> DataFrame:
    """id and token counts of JSON responses (id, body): the second spelling counts where the first is missing, the sum where no total is given; NULL without usage."""
    number = lambda k: F.get_json_object("usage", f"$.{k}").try_cast("long")
    first = lambda *ks: F.coalesce(*[F.when(number(k) >= 0, number(k)) for k in ks], F.lit(0).cast("long"))
    usage = responses.select("id", F.get_json_object("body", "$.usage").alias("usage")).where(F.col("usage").startswith("{"))
    n = usage.select("id", first("prompt_tokens", "input_tokens").alias("prompt_tokens"), first("completion_tokens", "output_tokens").alias("completion_tokens"), first("total_tokens").alias("total"), first("precached_prompt_tokens").alias("precached_prompt_tokens"))
    return n.select("id", "prompt_tokens", "completion_tokens", F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "precached_prompt_tokens")


def sample_values(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``key``, column, sample: the first filled value of every column, in one pass."""
    cell = lambda c: F.when(F.col(c).cast("string") != "", F.struct(F.col(order).alias("at"), F.col(c).cast("string").alias("v")))
    first = rows.groupBy(key).agg(*[F.min(cell(c)).alias(c) for c in columns])
    long = first.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.v").alias("sample")) for c in columns])).alias("s"))
    return long.select(key, "s.column", "s.sample").where("sample is not null")


def run_context(runs: DataFrame, versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs (run_id, owner) with their current version (run_id, version, state) and its artifact (run_id, version, ...), NULLs where there is none."""
    current = versions.groupBy("run_id").agg(F.max_by(F.struct("version", "state"), "version").alias("v")).select("run_id", "v.version", "v.state")
    return runs.join(current, "run_id", "left").join(artifacts, ["run_id", "version"], "left")

