"""Registered queries of the core operators: name -> (spark, sf_dir) -> DataFrame. Names begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import names as N
from fieldweave.functions import texts as T
from fieldweave.functions import values as V
from fieldweave.operators import drafts as DR
from fieldweave.operators import evaluation as EV
from fieldweave.operators import extraction as X
from fieldweave.operators import feedback as FB
from fieldweave.operators import forms as FM
from fieldweave.operators import graph as G
from fieldweave.operators import history as H
from fieldweave.operators import layout as LY
from fieldweave.operators import matching as M
from fieldweave.operators import tables as TB
from fieldweave.operators import transform as TR
from fieldweave.plans import sample_log as SL


def line_place():
    """The place of a line in its order; line numbers repeat."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
    """Register ``f(table)``, where table(name) reads one table of the given folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[f.__name__] = run
    return f


ORDER_EXAMPLE = '{"order":{"key":0,"total":0.0},"status":"","urgent":false,"note":null}'
ORDER_MAPPING = {"order.key": "o_orderkey", "order.total": "o_totalprice", "status": "o_orderstatus", "urgent": "urgent", "note": None}


def _orders(table):
    low = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.concat_ws("", F.format_string("%.2f", "o_totalprice")))
    return table("orders").withColumn("urgent", F.when(F.col("o_orderpriority").startswith("1"), "yes").otherwise("no")).withColumn("o_totalprice", F.replace(low, F.lit("."), F.lit(",")))


@query
def p1_transform_orders(table):
    fields = TR.target_fields(ORDER_EXAMPLE)
    out = TR.transformed(_orders(table), ORDER_MAPPING, fields, keep=["o_orderkey"])
    return out.select("o_orderkey", F.col("order.key").alias("key"), F.col("order.total").alias("total"), "status", "urgent", F.size("_cast_errors").alias("faults"))


@query
def m37_validate_orders(table):
    fields = TR.target_fields(ORDER_EXAMPLE)
    out = TR.diagnostics(TR.transformed(_orders(table), ORDER_MAPPING, fields, keep=["o_orderkey"]), fields)
    return out.groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def p5_filled_rows(table):
    sparse = table("events").select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("a"), F.when(F.col("user_id") % 3 == 0, F.lit(" ")).otherwise("x").alias("b"), F.when(F.col("event_id") % 5 == 0, "y").alias("c"))
    return TR.filled_enough(sparse, ["a", "b", "c"]).select("event_id")


@query
def p19_wide_fields(table):
    e = table("events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return TR.wide(e, "user_id", "event_type", "k", ["click", "error", "purchase", "signup", "view"], "event_id")


@query
def f13_column_profile(table):
    return TR.profile(table("customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query
def f1_name_tokens(table):
    return table("part").select("p_partkey", N.prepared(F.col("p_type")).alias("n")).select("p_partkey", F.array_join("n.tokens", " ").alias("tokens"), "n.normalized", F.col("n.canonical_name").alias("canonical"))


@query
def f5_semantic_parts(table):
    log = SL.correction_log(table("events"))
    both = log.select(F.col("source").alias("label")).unionByName(log.select(F.col("target").alias("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("p", N.prepared(F.col("label"))).select("label", "n", "p.attribute", "p.entity", "p.role", F.array_join("p.hints", ",").alias("hints"))


@query
def f7_value_types(table):
    e = table("events").select(F.explode(F.array(F.col("value").cast("string"), F.col("event_type"), F.date_format("ts", "dd.MM.yyyy"), F.when(F.col("event_id") % 2 == 0, "Yes"), F.get_json_object("props", "$.k"))).alias("value"))
    return e.groupBy(V.value_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query
def f10_parse_values(table):
    raw = F.concat(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(""))
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    flag = V.parse_boolean(F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "no")).cast("string")
    return table("orders").select("o_orderkey", V.parse_number(raw).alias("number"), V.parse_date(shape).alias("day"), F.coalesce(flag, F.lit("unknown")).alias("flag"))


@query
def f8_column_names(table):
    return table("part").select("p_partkey", V.column_name(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"))).alias("a"), V.column_name(F.concat(F.lit("Ёмкость "), F.col("p_brand"), F.lit(" щука"))).alias("b"))


@query
def f18_repair_numbers(table):
    misread = F.translate(F.format_string("%.2f", "c_acctbal"), "01258-", "O|2sB—")
    return table("customer").select("c_custkey", V.repair_number(F.concat(F.lit(" "), misread)).alias("repaired"), V.repair_date(F.translate(F.concat_ws("/", F.lit("01"), (F.col("c_custkey") % 14 + 1).cast("string"), F.lit("2024")), "01", "Ol")).alias("day"))


@query
def f28_token_estimate(table):
    return table("conversations").groupBy("role").agg(F.sum(V.token_estimate(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("turns"))


@query
def f16_sentences(table):
    return table("documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query
def f17_headings(table):
    lines = table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))


@query
def x1_key_values(table):
    c = table("customer")
    text = F.concat(F.lit("Name: "), "c_name", F.lit("\nBalance : "), F.col("c_nationkey").cast("string"), F.lit("\nno pair here\nSegment:  "), "c_mktsegment", F.lit("\nname: other\nNAME: OTHER\nkey part - its value\n\ta : b"))
    return X.key_values(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query
def x3_text_facts(table):
    return X.text_facts(table("documents").select("doc_id", "text"))


@query
def x4_sections(table):
    return X.sections(table("documents").select("doc_id", "text"))


@query
def x5_delimited_tables(table):
    c = table("customer")
    built = F.concat(F.lit("name;segment\n"), "c_name", F.lit(";"), "c_mktsegment", F.lit("\n\nno table\nhere\n\n|a|b|c|\n|--|:---|---|\n|1|2|\n|4|5|"), F.col("c_nationkey").cast("string"), F.lit("|\n\nx  y\n1   2\n3  "), F.col("c_mktsegment"))
    docs = c.select(F.col("c_custkey").alias("doc_id"), built.alias("text")).unionByName(table("documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    return X.delimited_tables(docs)


@query
def sc16_html_items(table):
    return X.html_items(table("pages"))


@query
def a1_memory(table):
    return FB.memory(SL.correction_log(table("events")))


@query
def m15_personal_candidates(table):
    m = FB.memory(SL.correction_log(table("events")))
    score = FB.memory_score(F.col("mean_confidence"), F.col("success_count"), F.col("failure_count"), F.col("usage_count"), F.lit(0))
    return H.newest_per(m.withColumn("score", score), "user_id", [F.col("score").desc(), "source", "target"], 3).select("user_id", "source", "target", "score", "rank")


@query
def m20_pattern_stats(table):
    return FB.pattern_stats(SL.correction_log(table("events")))


@query
def m21_promotion(table):
    return FB.promotion(FB.pattern_stats(SL.correction_log(table("events")))).select("source", "target", "status", "reason")


@query
def m21_promotion_of_few(table):
    """Patterns of each week of the log on its own: few corrections each."""
    log = SL.correction_log(table("events")).withColumn("week", F.date_trunc("week", "ts"))
    return FB.promotion(FB.pattern_stats(log, by=["week"])).select("week", "source", "target", "status", "reason")


@query
def m22_bulk_promotion(table):
    return FB.bulk_promotion(FB.pattern_stats(SL.correction_log(table("events"))), stability=0.5).select("source", "target", "status", "reason")


@query
def m16_shared_candidates(table):
    stats = FB.promotion(FB.pattern_stats(SL.correction_log(table("events"))))
    return stats.where("status <> 'blocked_sensitive'").select("source", "target", FB.shared_score(F.col("mean_confidence"), F.col("acceptance"), F.col("support"), F.col("users"), F.lit(0)).alias("score"))


@query
def w16_status_changes(table):
    return FB.status_changes(SL.correction_log(table("events")))


@query
def u2_event_feed(table):
    return FB.event_feed(
        {
            "event": table("events").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("title")),
            "order": table("orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")),
            "shipment": table("lineitem").select(F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("title")),
        },
        50,
    )


@query
def m25_graph_edges(table):
    return G.edges(SL.correction_log(table("events")))


@query
def m26_graph_evidence(table):
    e = G.edges(SL.correction_log(table("events")))
    asked = SL.correction_log(table("events")).select(N.prepared(F.col("target"))["normalized"].alias("source"), N.prepared(F.lit("creationDate"))["normalized"].alias("target")).distinct()
    return G.candidates(e, asked.where("source <> target"))


@query
def m28_graph_clusters(table):
    return G.clusters(G.edges(SL.correction_log(table("events"))))


@query
def j6_incident_edges(table):
    e = G.edges(SL.correction_log(table("events")))
    return G.incident(e, e.where("relation = 'synonym'").select(F.col("r").alias("node"))).select("node", "other", "accepts", "rejects")


@query
def j1_run_history(table):
    runs, owners = table("orders").withColumnRenamed("o_orderkey", "run").withColumnRenamed("o_custkey", "owner"), table("customer").select(F.col("c_custkey").alias("owner"), "c_name")
    totals = [F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines")]
    out = H.run_history(runs, owners, table("lineitem").withColumnRenamed("l_orderkey", "run"), "run", "owner", [F.col("o_orderdate").desc(), F.col("run").desc()], 100, totals)
    return out.select(F.col("run").alias("o_orderkey"), "o_orderdate", "c_name", "last_ship", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query
def a9_token_totals(table):
    return H.token_totals(table("conversations"))


@query
def a10_usage_report(table):
    t = H.token_totals(table("conversations")).withColumn("size", F.when(F.col("turns") <= 2, "short").otherwise("long"))
    return H.usage_report(t, "size")


@query
def w15_versions(table):
    e = table("events").select("user_id", "ts", "event_id", "event_type")
    return H.versions(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "version")


@query
def m43_expired(table):
    return H.expired(table("events"), "ts", "2024-01-20 00:00:00").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def w14_newest_orders(table):
    return H.newest_per(table("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3)


@query
def w13_spread_sample(table):
    return H.spread_sample(table("lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")), "l_suppkey", "line", 5).select("l_suppkey", "line", "i")


def _cases(table):
    """Whether a text of repeated words is found to be of low quality, against the reviewers' labels."""
    words = F.size(F.split("text", " "))
    rule = F.when(F.size(F.array_distinct(F.split("text", " "))) / words < 0.3, 0).otherwise(1)
    return table("documents").join(table("labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("expected"), rule.alias("got"))


@query
def a11_accuracy(table):
    return EV.accuracy(_cases(table).withColumn("right", F.col("expected") == F.col("got")), "lang", "right")


@query
def a12_outcomes(table):
    c = _cases(table).withColumn("got", F.when(F.col("doc_id") % 10 == 0, F.lit(None)).otherwise(F.col("got")))
    return EV.outcomes(c, "lang", "expected", "got")


@query
def a13_deltas(table):
    on = _cases(table).withColumn("right", F.col("expected") == F.col("got"))
    off = _cases(table).withColumn("right", F.col("expected") == 1)
    return EV.deltas(off, on, "doc_id", "right").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def a15_run_status(table):
    runs = table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("l_returnflag") == "R").alias("unresolved"), F.count_if(F.col("l_linestatus") == "O").alias("suggested"))
    return EV.run_status(runs)


@query
def m33_snapshot(table):
    items = EV.curated(table("events").select(F.col("event_id").alias("id"), "value"), F.col("value") / 100)
    return EV.snapshot(items, 0.75, ["approved", "candidate"])


@query
def m35_feature_vectors(table):
    """A user's log as a run: its labels in the order of the log, with repeats."""
    log = SL.correction_log(table("events")).withColumn("s", N.prepared(F.col("source"))["normalized"]).withColumn("t", N.prepared(F.col("target"))["normalized"])
    band = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col(c).alias("name")))), lambda x: x["name"])
    runs = log.groupBy(F.col("user_id").alias("id")).agg(
        names("s").alias("sources"), names("t").alias("targets"), F.count(F.lit(1)).alias("rows"), F.lit(1).alias("sheets"),
        *[F.count_if(band == b).alias(b) for b in ("high", "medium", "low", "none")], F.count_if(~F.col("accepted")).alias("warnings"),
    )
    out = EV.feature_vectors(runs.withColumn("file_type", F.get(F.array(F.lit("csv"), F.lit("xls"), F.lit("pdf"), F.lit("txt")), F.pmod("id", F.lit(4)).cast("int"))))
    words = F.array_sort(F.transform(F.map_entries("tokens"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("id", "vector", F.array_join(words, " ").alias("tokens"), F.round("l2_norm", 6).alias("l2_norm"))


def _lines(table):
    """The lines of every document, laid out with a wider step after every fifth: doc_id, text, words, zone, y."""
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).where(F.trim("text") != "")
    return lines.select("doc_id", "text", T.word_count(F.col("text")).alias("words"), T.line_zone(F.col("text")).alias("zone"), (F.col("at") * 14.0 + F.floor(F.col("at") / 5) * 20).alias("y"))


@query
def l3_line_zones(table):
    return _lines(table).groupBy("doc_id", "zone").agg(F.count(F.lit(1)).alias("n"))


@query
def w6_region_zones(table):
    return LY.region_zones(LY.regions(_lines(table), "doc_id", "y"), "doc_id")


@query
def l3_page_classes(table):
    return LY.page_class(LY.region_zones(LY.regions(_lines(table), "doc_id", "y"), "doc_id"), "doc_id")


@query
def w8_line_segments(table):
    return LY.segments(table("documents").select("doc_id", F.regexp_replace("text", r"\. ", ".           ").alias("text")))


def _page():
    """A page for each user and week: pages stay small and grow in number with the log."""
    week = F.floor(F.datediff(F.to_date(F.date_trunc("week", "ts")), F.lit("1970-01-05").cast("date")) / 7)
    return (F.col("user_id") * 10_000 + week).cast("long").alias("page")


@query
def w9_row_bands(table):
    w = table("events").select(_page(), F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("event_id") % 700).cast("double").alias("y"), F.lit(10.0).alias("height"))
    return LY.row_bands(w)


@query
def l7_unique_names(table):
    """An order's lines as header cells: equal but for case, with blanks to squeeze, some of them empty."""
    status = F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_linestatus")).when(F.col("l_returnflag") == "R", F.lit("  ")).otherwise(F.col("l_linestatus"))
    cells = table("lineitem").select("l_orderkey", "l_linenumber", line_place(), F.when(F.col("l_quantity") > 25, F.concat(status, F.lit("  a "))).otherwise(status).alias("cell"))
    return TB.header_names(cells, "l_orderkey", "at", "cell").select("l_orderkey", "l_linenumber", F.col("unique").alias("unique_name"))


def _match_case(table):
    """The log's labels as sources (their users as cases) and the log's targets as targets, with a sample value."""
    log = SL.correction_log(table("events"))
    s = log.groupBy(F.col("user_id").alias("case_id"), "source").agg(F.min("event_id").alias("source_pos"), F.min_by(F.format_string("%.1f", "confidence"), "event_id").alias("sample"))
    t = log.groupBy(F.col("user_id").alias("case_id"), "target").agg(F.min("event_id").alias("target_pos"))
    return M.pairs(s, t.withColumn("type", F.when(F.col("target").isin("amount", "revenue"), "number").otherwise("string")))


@query
def m2_rule_matches(table):
    p = _match_case(table).withColumn("rule", M.rule(F.col("s"), F.col("t"))).where("rule is not null")
    return p.groupBy("source", "target", "rule.name", "rule.band").agg(F.count(F.lit(1)).alias("cases"))


@query
def m7_base_scores(table):
    p = _match_case(table)
    return p.select("case_id", "source", "target", F.round(M.base_score(F.col("s"), F.col("t"), F.col("type"), F.col("sample"), F.lit(0.0)), 6).alias("score"))


@query
def m7_scored_candidates(table):
    return M.scored(_match_case(table)).select("case_id", "target", "source", "rank", "score")


@query
def m1_assignment(table):
    return M.assigned(_match_case(table))


@query
def s1_acceptance_windows(table):
    log = SL.correction_log(table("events"))
    w = log.groupBy(F.window("ts", "6 hours").alias("w"), "source").agg(F.count_if("accepted").alias("accepts"), F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("from_ts"), "source", "accepts", "n")


@query
def p18_best_row_group(table):
    e = table("events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"), F.when(F.col("value") > 30, F.col("value")).alias("net_amount"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("owner"))
    return TB.best_row_group(e, ["kind", "net_amount", "owner"], ["Kind", "amount", "net"]).select("event_id", "signature")


@query
def w4_blocks(table):
    lines = table("documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("\n\n")), "\n")).alias("pos", "line"))
    return TB.blocks(lines, "doc_id", "pos", "line").groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"))


@query
def w10_first_of_equal(table):
    return TB.first_of_equal(table("part").select("p_partkey", "p_brand", "p_type"), [F.lower("p_brand"), F.lower("p_type")], "p_partkey")


def _ocr_cells(table):
    """Cells with misread signs: table, col, value."""
    misread = lambda x: F.translate(x, "01", "Ol")
    cells = F.array(misread(F.col("o_orderkey").cast("string")), misread(F.date_format("o_orderdate", "dd.MM.yyyy")), F.concat(F.lit("Хoлoд "), F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == "F", "1O,5").otherwise("none"))
    return table("orders").select((F.col("o_custkey") % 50).alias("table"), F.posexplode(cells).alias("col", "value"))


@query
def a20_column_types(table):
    return TB.column_types(_ocr_cells(table))


@query
def l6_repaired_cells(table):
    return TB.repaired_cells(_ocr_cells(table)).groupBy("table", "col", "type").agg(F.count_if(F.col("repaired") == "").alias("empty"), F.min("repaired").alias("least"), F.max("repaired").alias("most"))


@query
def a25_dominant_width(table):
    rows = table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.size(F.split("line", " ")).alias("width"))
    return TB.dominant_width(rows, "doc_id", "width")


def _flat(table):
    """Three rows of six cells for each customer, without a line break between them."""
    row = lambda k: [F.concat(F.lit("deal_"), F.col("c_custkey").cast("string")), F.concat(F.lit("item "), F.col("c_name")), F.lit(f"2024-01-1{k}"), F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, "ООО Ромашка").otherwise("Иван Петров"), F.format_string("%.2f", "c_acctbal")]
    text = F.concat_ws(" | ", *[x for k in range(3) for x in row(k)])
    return TB.flat_cells(table("customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query
def a21_repeated_width(table):
    return TB.repeated_width(_flat(table))


@query
def a22_repeated_columns(table):
    return TB.repeated_columns(_flat(table))


@query
def m44_structure_changes(table):
    """Suppliers as the old state, customers as the new one, by key."""
    old = table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    new = table("customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    orders = table("orders").groupBy((-F.col("o_custkey")).alias("key")).agg(F.count(F.lit(1)).alias("nation"))
    return TB.changes(old.unionByName(orders), new, "key", ["nation"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query
def m36_fingerprints(table):
    return table("part").select("p_partkey", TB.fingerprint(F.col("p_brand"), F.lower("p_type"), F.col("p_size").cast("string")).alias("fingerprint"))


@query
def sc13_delimiters(table):
    return table("documents").select("doc_id", TB.delimiter(F.col("text")).alias("delimiter"))


@query
def sc9_usable_text(table):
    return table("documents").groupBy("lang", TB.usable_text(F.col("text")).alias("usable")).agg(F.count(F.lit(1)).alias("n"))


@query
def j9_item_owners(table):
    kind = F.when(F.col("l_returnflag") == "R", "customer").when(F.col("l_returnflag") == "A", "part").otherwise("supplier")
    ref = F.when(kind == "customer", F.col("l_orderkey") % 1500).when(kind == "part", F.col("l_partkey")).otherwise(F.col("l_suppkey"))
    items = table("lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), ref.alias("ref"))
    return TB.owners(items, {"customer": (table("customer"), "c_custkey", "c_name"), "part": (table("part"), "p_partkey", "p_name"), "supplier": (table("supplier"), "s_suppkey", "s_name")}).fillna("none", ["owner"])


@query
def j10_relevant_orders(table):
    keys = table("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).unionByName(table("orders").where("o_orderpriority like '1%'").select("o_orderkey"))
    return table("orders").join(keys.distinct(), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query
def p16_token_users(table):
    return TB.token_users(SL.correction_log(table("events")), ["customer", "amount", "date", "revenue", "phone"])


@query
def t2_pattern_list(table):
    p = FB.promotion(FB.pattern_stats(SL.correction_log(table("events"))))
    rank = F.when(F.col("status") == "shared_promoted", 3).when(F.col("status") == "shared_candidate", 2).when(F.col("status") == "personal_only", 1).otherwise(0)
    return p.orderBy(rank.desc(), F.col("acceptance").desc(), F.col("support").desc(), "source", "target").limit(12).select("source", "target", "status", "support")


@query
def j3_memory_layers(table):
    log = SL.correction_log(table("events"))
    per = FB.memory(log).groupBy("source").agg(F.count(F.lit(1)).alias("remembered"), F.sum("usage_count").alias("uses"))
    seen = log.groupBy("source").agg(F.count_if(~F.col("accepted")).alias("rejected"), F.count_distinct("user_id").alias("users"))
    return per.join(seen, "source")


@query
def u3_united_sheets(table):
    a = table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).fillna("", ["segment"]).fillna(0.0, ["balance"])


def _form_lines(table):
    """A small form for each customer: a box before any question, a question with boxes and a line between, one without a choice."""
    seg = lambda s: F.concat(F.when(F.col("c_mktsegment") == s, "[x] ").otherwise("[ ] "), F.lit(s))
    lines = F.array(F.lit("[x] early"), F.lit("Which segment?"), F.lit("Pick one"), seg("BUILDING"), seg("MACHINERY"), F.concat(F.when(F.col("c_nationkey") > 12, "☑ ").otherwise("☐ "), F.lit("Other")), F.lit("A line between"), F.lit("[ ] stray"), F.lit("Any of these apply:"), F.lit("☐ first"), F.lit("[ ] second"))
    return table("customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("pos", "line"))


@query
def w17_form_groups(table):
    return FM.groups(_form_lines(table))


@query
def l16_form_answers(table):
    return FM.answers(FM.groups(_form_lines(table)), {"building": "B", "machinery": "M", "first": "1"})


@query
def l1_word_lines(table):
    return FM.lines_of(table("events").select(_page(), F.col("event_id").alias("id"), (F.col("event_id") % 300).cast("double").alias("top"), F.col("value").alias("x0")))


def _cascade_candidates(table):
    log = SL.correction_log(table("events"))
    p = _match_case(table).select("case_id", "target_pos", "target", "source", M.rule(F.col("s"), F.col("t")).alias("rule"))
    ruled = p.where("rule is not null").select("case_id", "target_pos", "target", "source", F.lit("deterministic").alias("tier"), (1 - F.col("rule.rank") / 10).alias("score"))
    at = p.select("case_id", "target_pos", "target", "source")
    m = FB.memory(log)
    own = m.select(F.col("user_id").alias("case_id"), "source", "target", FB.memory_score(F.col("mean_confidence"), F.col("success_count"), F.col("failure_count"), F.col("usage_count"), F.lit(0)).alias("score"))
    stats = FB.promotion(FB.pattern_stats(log)).where("status = 'shared_promoted'")
    shared = stats.select("source", "target", FB.shared_score(F.col("mean_confidence"), F.col("acceptance"), F.col("support"), F.col("users"), F.lit(0)).alias("score"))
    named = p.withColumn("l", N.prepared(F.col("source"))["normalized"]).withColumn("r", N.prepared(F.col("target"))["normalized"]).select("case_id", "target_pos", "target", "source", "l", "r")
    hints = G.candidates(G.edges(log), named.select(F.col("l").alias("source"), F.col("r").alias("target")).where("source <> target")).select(F.col("source").alias("l"), F.col("target").alias("r"), "score")
    graph = named.join(hints, ["l", "r"]).select("case_id", "target_pos", "target", "source", F.lit("semantic_graph").alias("tier"), "score")
    ruled = ruled.unionByName(graph)
    return ruled.unionByName(at.join(own, ["case_id", "source", "target"]).withColumn("tier", F.lit("personal_memory"))).unionByName(at.join(shared, ["source", "target"]).withColumn("tier", F.lit("global_pattern")))


@query
def m6_cascade(table):
    return DR.cascade(_cascade_candidates(table))


@query
def m18_draft_names(table):
    log = SL.correction_log(table("events"))
    m = FB.memory(log).withColumn("score", FB.memory_score(F.col("mean_confidence"), F.col("success_count"), F.col("failure_count"), F.col("usage_count"), F.lit(0)))
    own = m.groupBy("user_id", "source").agg(F.max_by("target", F.struct("score", "target")).alias("target"), F.max("score").alias("score"))
    cols = own.withColumn("target", F.when(F.col("user_id") % 3 == 0, F.col("target")))
    stats = FB.promotion(FB.pattern_stats(log)).where("status <> 'blocked_sensitive'")
    shared = stats.withColumn("score", FB.shared_score(F.col("mean_confidence"), F.col("acceptance"), F.col("support"), F.col("users"), F.lit(0)))
    shared = shared.groupBy("source").agg(F.max_by("target", F.struct("score", "target")).alias("shared"), F.max("score").alias("shared_score"))
    both = cols.join(shared, "source", "left").withColumn("shared", F.when(F.col("user_id") % 3 == 1, F.col("shared")))
    return both.select("user_id", "source", DR.draft_name(F.col("target"), F.when(F.col("target").isNotNull(), F.col("score")), F.col("shared"), F.col("shared_score"), F.col("source")).alias("name"))


@query
def a14_run_quality(table):
    band = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").when(F.col("l_linenumber") % 2 == 0, "low").otherwise("none")
    return DR.run_quality(table("lineitem").select("l_orderkey", band.alias("band"), (F.col("l_linenumber") - 1).alias("w")), "l_orderkey", "band", F.col("w"))


from fieldweave.plans import form_queries, graph_queries, json_queries, more_queries, quality_queries, read_queries, state_queries  # noqa: E402,F401  register the rest
