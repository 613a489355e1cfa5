"""Registered queries of form, table, learning-state and draft operators. Imported by ``queries`` last, whose registry it fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.functions import names as N
from fieldweave.functions import texts as T
from fieldweave.functions import values as V
from fieldweave.operators import evaluation as EV
from fieldweave.operators import extraction as X
from fieldweave.operators import feedback as FB
from fieldweave.operators import graph as G
from fieldweave.operators import history as H
from fieldweave.operators import learning as LE
from fieldweave.operators import matching as M
from fieldweave.operators import review as RV
from fieldweave.operators import tables as TB
from fieldweave.plans import sample_log as SL
from fieldweave.plans.queries import line_place, query


def _memory(table):
    return FB.memory(SL.correction_log(table("events")))


def _patterns(table):
    return FB.promotion(FB.pattern_stats(SL.correction_log(table("events"))))


@query
def f9_placeholders(table):
    value = F.when(F.col("o_orderkey") % 5 == 0, " N/A ").when(F.col("o_orderkey") % 5 == 1, "—").when(F.col("o_orderkey") % 5 == 2, F.col("o_orderpriority")).when(F.col("o_orderkey") % 5 == 3, "")
    return table("orders").groupBy(V.is_placeholder(value).alias("placeholder"), V.visible(value).alias("visible")).agg(F.count(F.lit(1)).alias("n"))


@query
def f14_representatives(table):
    """The value that stands for a column of a user's events: numbers, types and dates, some of them sparse."""
    e = table("events")
    cell = lambda c, kind, name: F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), c.alias("value"))
    cells = F.array(
        cell(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(",0"))), "number", "k"),
        cell(F.when(F.col("event_id") % 29 == 0, F.col("event_type")), "string", "rare"),
        cell(F.when(F.col("event_id") % 2 == 0, "n/a").otherwise(F.col("event_type")), "string", "type"),
        cell(F.date_format("ts", "dd.MM.yyyy"), "string", "day"),
        cell(F.when(F.col("value") > 50, "maybe").otherwise("Да"), "boolean", "flag"),
    )
    long = e.select("user_id", "event_id", F.explode(cells).alias("c")).groupBy("user_id", "c.column", "c.kind").agg(F.array_sort(F.collect_list(F.when(V.visible(F.col("c.value")), F.struct("event_id", F.col("c.value").alias("v"))))).alias("vs"), F.count(F.lit(1)).alias("n"))
    return long.select("user_id", "column", V.representative(F.transform("vs", lambda x: x["v"]), F.col("kind"), F.col("n")).alias("value"))


@query
def f19_one_script(table):
    return table("customer").select("c_custkey", V.one_script(F.concat(F.when(F.col("c_custkey") % 2 == 0, "Хoлдинг ").otherwise("Cоrp "), F.col("c_mktsegment"))).alias("value"))


@query
def f25_cleaned_names(table):
    label = F.concat(F.lit("Email клиента "), "p_type", F.lit(" "), "p_partkey")
    return table("part").select("p_partkey", F.array_join(FB.cleaned(N.prepared(label)["canonical"]), " ").alias("cleaned"))


@query
def f33_headers(table):
    return table("part").select("p_partkey", V.excel_header(F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 30, "  ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))), F.col("p_size")).alias("header"))


@query
def f34_residency(table):
    nowhere = "Не являюсь налоговым  резидентом ни в одном государстве"
    answer = F.when(F.col("c_nationkey") < 5, F.lit("[ ] x " + nowhere)).when(F.col("c_nationkey") < 10, F.lit("Да, " + nowhere)).when(F.col("c_nationkey") < 15, "вопрос X НЕТ ответ").when(F.col("c_nationkey") < 20, F.lit(nowhere)).otherwise(F.col("c_mktsegment"))
    return table("customer").select("c_custkey", F.coalesce(T.residency(answer), F.lit("none")).alias("answer"))


@query
def f23_phrase_similarity(table):
    words = lambda c: F.split(F.lower(c), r"[^a-z0-9]+")
    return table("part").select("p_partkey", F.round(T.phrase_similarity(words(F.col("p_type")), words(F.col("p_name"))), 6).alias("names"), F.round(T.phrase_similarity(words(F.col("p_type")), words(F.regexp_replace("p_type", r"^[A-Z]+ ", ""))), 6).alias("shorter"))


@query
def m48_normal_pairs(table):
    pairs = SL.correction_log(table("events")).select(F.col("source").alias("label"), F.col("target").alias("field")).distinct()
    return LE.normal_pairs(pairs).fillna("", ["role", "concept"])


@query
def w11_unique_keys(table):
    """Keys of an order's lines; some end in a number as if they had been made unique before."""
    key = F.when(F.col("l_linenumber") % 3 == 0, F.concat("l_returnflag", F.lit("2"))).otherwise(F.col("l_returnflag"))
    names = table("lineitem").select("l_orderkey", "l_linenumber", line_place(), V.column_name(key).alias("key"))
    return TB.unique_names(names, "l_orderkey", "at", "key").select("l_orderkey", "l_linenumber", F.col("unique").alias("key"))


@query
def w12_unique_labels(table):
    label = F.when(F.col("l_quantity") > 25, F.concat("l_linestatus", F.lit(" 2"))).otherwise(F.col("l_linestatus"))
    names = table("lineitem").select("l_orderkey", "l_linenumber", line_place(), label.alias("label"))
    return TB.unique_names(names, "l_orderkey", "at", "label", " ").select("l_orderkey", "l_linenumber", F.col("unique").alias("label"))


@query
def x2_inline_pairs(table):
    """Known labels in running text, with no-break spaces among the blanks."""
    c = table("customer")
    text = F.concat(F.lit("Full name\u00a0"), "c_name", F.lit(",\u00a0phone number: +7 "), F.col("c_custkey").cast("string"), F.lit("; адрес -\u00a0 Town\u00a0"), F.col("c_nationkey").cast("string"), F.lit("\nE-mail\u00a0\u00a0x@y.zz"))
    return X.key_values(c.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") > 20, "Full name only here").otherwise(text).alias("text")))


@query
def x6_markdown_rows(table):
    c = table("customer")
    rule = F.when(F.col("c_nationkey") > 20, "| x | y |").otherwise("|:---|---:|")
    text = F.concat(F.lit("before\n| name | segment |\n"), rule, F.lit("\n| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |\n| short |\n| a | b |\nafter\n| not | read |"))
    return X.markdown_rows(c.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))


@query
def x7_wide_pairs(table):
    """Orders as paragraphs of a customer's document; customers of one order have no table, and urgent orders lack a column."""
    o = table("orders")
    urgent = F.concat(F.lit("rush: yes, key: "), F.col("o_orderkey").cast("string"))
    paragraph = F.concat(F.lit("key: "), F.col("o_orderkey").cast("string"), F.lit(", order status : "), "o_orderstatus", F.lit(", priority:"), "o_orderpriority")
    return X.wide_pairs(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("row"), F.when(F.col("o_orderpriority") == "1-URGENT", urgent).otherwise(paragraph).alias("paragraph")))


@query
def x11_document_kinds(table):
    c = table("customer")
    texts = [F.lit("a: b\nc: d"), F.lit("x;y\n1;2"), F.lit("short"), F.concat(F.lit("a long line about "), "c_name"), F.concat(F.lit("k: v\n\nx|y|\n1|2|\n\n"), "c_name"), F.lit(None).cast("string")]
    made = c.select(F.col("c_custkey").alias("doc_id"), F.get(F.array(*texts), (F.col("c_custkey") % len(texts)).cast("int")).alias("text"))
    docs = made.unionByName(table("documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    return X.document_kind(docs).groupBy("content_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def sc15_quoted_cells(table):
    c = table("customer")
    line = F.concat(F.lit('"'), "c_name", F.lit(', the ""first""" , '), "c_mktsegment", F.lit(",,x"))
    return c.select("c_custkey", F.array_join(TB.quote_aware(line, ","), "~").alias("cells"), F.size(TB.quote_aware(line, ",")).alias("n"))


@query
def p8_codes(table):
    value = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise(F.upper(F.concat(F.lit("a-"), F.col("p_partkey").cast("string"))))
    return table("part").select("p_partkey", V.is_code(value).alias("code"))


@query
def p9_useful_labels(table):
    label = F.when(F.col("o_orderkey") % 4 == 0, "• bullet").when(F.col("o_orderkey") % 4 == 1, "A HEADING OF MANY CAPITALS").when(F.col("o_orderkey") % 4 == 2, "").otherwise("Plain label")
    return table("orders").groupBy("o_orderpriority", T.useful_label(label, F.concat(F.lit("X "), F.col("o_orderpriority"))).alias("useful")).agg(F.count(F.lit(1)).alias("n"))


@query
def u7_deduped(table):
    """Candidates of an order's lines: equal in type, label and value but for case."""
    line = table("lineitem").withColumn("n", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    label = F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    rows = line.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "n", F.when(F.col("l_quantity") > 25, "kv_pair").otherwise("text_fact").alias("type"), label.alias("label"), F.when(F.col("l_quantity") > 10, F.col("l_linestatus")).alias("value"))
    return X.deduped(rows, ["doc_id", "type", "label", "value"], "n").select("doc_id", "l_linenumber", "type", "label", F.coalesce("value", F.lit("none")).alias("value"))


@query
def t8_text_blocks(table):
    return X.text_blocks(table("documents").select("doc_id", "text"))


@query
def a1_learning_counts(table):
    return LE.counts(SL.suggestions(table("events")), _memory(table))


@query
def a2_staging_counts(table):
    return LE.staging_counts(SL.suggestions(table("events")))


@query
def t1_staging_list(table):
    return LE.staging(SL.suggestions(table("events")).where("source is not null"), 5).select("user_id", "source", "target", "truth", "status", "seen", "max_confidence", "last_seen", "rank")


@query
def a8_review_states(table):
    return LE.review_state(SL.suggestions(table("events")))


def _user_edges(table):
    log = SL.correction_log(table("events"))
    s, t = N.prepared(F.col("source"))["normalized"], N.prepared(F.col("target"))["normalized"]
    pairs = log.groupBy("user_id", "source", "target").agg(F.count_if("accepted").alias("accepts"), F.count_if(~F.col("accepted")).alias("rejects"))
    return pairs.select("user_id", F.least(s, t).alias("l"), F.greatest(s, t).alias("r"), "accepts", "rejects").where("l <> r")


@query
def m29_memory_layers(table):
    out = LE.layers(SL.suggestions(table("events")), _memory(table), _patterns(table), _user_edges(table))
    return out.select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "layer", "kind", "n")


@query
def j5_touched_nodes(table):
    return G.touched_nodes(_user_edges(table))


@query
def t3_remembered(table):
    log = SL.correction_log(table("events"))
    used = log.groupBy("user_id", "source", "target").agg(F.max("ts").alias("last_used"))
    m = _memory(table).join(used, ["user_id", "source", "target"])
    return LE.remembered(m, F.col("target").isin("amount", "name"), 4).select("user_id", "source", "target", "schema_match", "success_count", "rank")


@query
def j11_shared_lookup(table):
    asked = SL.correction_log(table("events")).where("confidence > 0.8").select("source", "target")
    return LE.shared_lookup(_patterns(table), asked, True, 3, F.col("concept").startswith("finance")).select("source", "target", "status", "support", "rank")


@query
def j12_promotable(table):
    return LE.promotable(_patterns(table), 3, 2, 0.5, 0.5).select("source", "target", "status", "acceptance")


@query
def p15_active_tokens(table):
    c = table("customer")
    registry = c.select(F.concat(F.lit(" "), "c_mktsegment").alias("token"), F.when(F.col("c_nationkey") < 3, "global").when(F.col("c_nationkey") < 20, "user").otherwise("none").alias("scope"), F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"))
    return LE.active_tokens(registry).select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "token")


@query
def j15_run_counts(table):
    return LE.run_counts(table("customer").select("c_custkey"), table("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query
def j20_case_deltas(table):
    """Suppliers as cases of two runs over all their lines; below zero orders, whose open lines are the run with the graph and whose others the run without: many lack one run, some both."""
    line = table("lineitem").select("*", (-F.col("l_orderkey") - 1).alias("l_case"))
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rates = lambda rows, case, exact, wrong, left: rows.groupBy(F.col(case).alias("case_id")).agg(rate(exact).alias("exact"), rate(wrong).alias("false_positive"), rate(left).alias("unresolved"))
    flags, is_open = [F.col("l_returnflag") == f for f in "ARN"], F.col("l_linestatus") == "O"
    off = rates(line, "l_suppkey", *flags).unionByName(rates(line.where(~F.coalesce(is_open, F.lit(False))), "l_case", *flags))
    on = rates(line, "l_suppkey", F.col("l_linenumber") == 1, F.col("l_linenumber") == 2, is_open).unionByName(rates(line.where(is_open), "l_case", *flags))
    cases = table("supplier").select(F.col("s_suppkey").alias("case_id")).unionByName(table("orders").select((-F.col("o_orderkey") - 1).alias("case_id")))
    return EV.graph_deltas(off, on, cases.distinct())


@query
def m12_final_confidence(table):
    e = table("events").select("event_id", (F.col("value") / 80).alias("model"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 100) / 100).alias("prior"), F.when(F.col("event_id") % 10 == 0, 0.72).otherwise(0.0).alias("conflict"))
    final = M.final_confidence(F.col("model"), F.col("prior"), F.col("conflict"))
    reason = M.gate(F.when(F.col("event_id") % 13 == 0, " ").otherwise("a"), F.col("event_id") % 17 == 0, F.when(F.col("conflict") > 0, "amount_vs_revenue"), F.when(F.col("model") < 0.4, "low").otherwise("high"), final)
    return e.select("event_id", F.round(final, 6).alias("final"), F.coalesce(reason, F.lit("accepted")).alias("reason"))


@query
def m13_routed(table):
    line = table("lineitem")
    tier = F.when(F.col("l_linenumber") == 1, "position_fallback").otherwise("personal_memory")
    band = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    m = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 6, "s").alias("source"), tier.alias("tier"), band.alias("band"), F.col("l_discount").alias("score"), F.when(F.col("l_orderkey") % 2 == 0, "PDF").otherwise("csv").alias("file_type"), F.lit("form_layout_mode").alias("mode"), (F.col("l_partkey") % 2 == 0).alias("prefer_table"), (F.col("l_partkey") % 3 == 0).alias("weak_form"))
    return M.routed(m).groupBy("file_type", "band", "new_band", "penalty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("new_score"), 4).alias("score"))


@query
def m5_by_position(table):
    """Lines of an order as sources and targets; urgent orders have a target more, and a returned line is a match. Every target of every order has a row."""
    line, orders = table("lineitem"), table("orders")
    source, back, none = F.concat(F.lit("c"), F.col("l_partkey").cast("string")), F.col("l_returnflag") == "R", F.lit(None).cast("string")
    sources = line.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("source_pos"), source.alias("source"))
    match = [F.when(back, source).alias("source"), F.when(back, "high").alias("band"), F.when(back, "returned").alias("reason")]
    targets = line.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("target_pos"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("target"), *match)
    more = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("case_id"), F.lit(100).alias("target_pos"), F.lit("more").alias("target"), none.alias("source"), none.alias("band"), none.alias("reason"))
    return M.with_positions(sources, targets.unionByName(more)).withColumn("source", F.coalesce("source", F.lit("none")))


@query
def w2_picked(table):
    line = table("lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber") % 2).cast("string").alias("target"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("source"), F.col("l_discount").alias("score"), F.col("l_tax").alias("confidence"), (F.col("l_returnflag") == "R").alias("used"))
    return LE.picked(line, 0.04)


@query
def m28_cluster_summary(table):
    log = SL.correction_log(table("events"))
    both = log.select(F.col("source").alias("label")).unionByName(log.select(F.col("target").alias("label"))).distinct().withColumn("p", N.prepared(F.col("label")))
    meanings = both.select(F.col("p.normalized").alias("node"), "p.attribute", "p.role", "p.entity").distinct()
    return G.cluster_summary(G.edges(log), meanings)


@query
def m27_context_fit(table):
    pairs = SL.correction_log(table("events")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("source", "target", "n", G.context_fit(N.prepared(F.col("target")), N.prepared(F.col("source"))).alias("fit"))


@query
def m34_training_examples(table):
    """Corrections as examples of a mapping, purchases as templates whose target is a draft."""
    log = SL.correction_log(table("events"))
    target = F.when(F.col("accepted"), F.col("target"))
    payload = F.when(F.col("source") == "revenue amount", F.to_json(F.struct(F.struct(F.lit(0).alias("value")).alias("draft_json")))).otherwise(F.to_json(F.struct("confidence", target.alias("target")), {"ignoreNullFields": "false"}))
    rows = log.select(F.col("event_id").alias("id"), F.when(F.col("source") == "email", "template").otherwise("correction").alias("item_kind"), F.when(F.col("source") == "email", F.lit("[1]")).otherwise(F.to_json(F.struct("source", "user_id"))).alias("input_payload"), payload.alias("target_payload"), "confidence")
    found = EV.training_examples(EV.curated(rows, F.col("confidence")))
    return found.select("id", "task_type", "item_kind", "split", "quality_score", F.transform("messages", lambda m: F.concat_ws(" ", m["role"], m["content"])).alias("messages"))


@query
def j14_snapshot_runs(table):
    """Training runs with the size of the snapshot (a day's items) each was made from."""
    items = EV.curated(table("events").select(F.col("event_id").alias("id"), "value", F.dayofyear("ts").alias("snapshot")), F.col("value") / 100)
    sizes = items.groupBy("snapshot").agg(F.count(F.lit(1)).alias("items"))
    runs = table("orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("snapshot"))
    return runs.join(sizes, "snapshot", "left").groupBy("items").agg(F.count(F.lit(1)).alias("runs")).fillna(-1, ["items"])


@query
def p4_expected_sources(table):
    m = table("lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"))).alias("source"))
    return RV.expected_sources(m).select("case_id", F.array_join("sources", ",").alias("sources"))


@query
def p13_usable_previews(table):
    rows = table("lineitem").select(F.col("l_orderkey").alias("table"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_quantity") > 40, F.col("l_returnflag")).alias("a"), F.when(F.col("l_discount") > 0.05, F.lit(" ")).otherwise("x").alias("b"))
    return RV.usable_previews(rows, ["a", "b"])


@query
def p17_found_events(table):
    e = table("events").select("event_id", F.col("event_type").alias("stage"), F.concat(F.lit("Event "), F.col("user_id").cast("string")).alias("title"), F.col("props").alias("description"))
    return RV.found_events(e, "click", ' "K": 1 ').select("event_id")


@query
def a24_stage_counts(table):
    return RV.stage_counts(table("events").withColumnRenamed("event_type", "stage"), ["click", "view", "signup"])


@query
def w7_zone_edges(table):
    z = table("lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 3).alias("column_id"), F.col("l_quantity").alias("y"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("zone_id")).distinct()
    return RV.zone_edges(z).groupBy("page", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("from_zone").alias("least_from"), F.max("to_zone").alias("most_to"))


@query
def t6_reading_order(table):
    e = table("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3).alias("page"), (F.col("event_id") % 2).alias("column_id"), F.col("value").alias("y"), F.lit(1.0).alias("x"))
    return RV.reading_order(e).select("line_id", "place")


@query
def u4_united_sheets(table):
    o = table("orders").groupBy((F.col("o_custkey")).alias("book"), F.col("o_orderpriority").alias("sheet")).agg(F.min("o_orderkey").alias("pos"), F.count_if(F.col("o_orderstatus") == "F").alias("rows"))
    tables = o.withColumn("columns", F.array(F.lit("key"), F.concat(F.lit("c"), F.substring("sheet", 1, 1))))
    return RV.united_sheets(tables).select("book", F.array_join("columns", ",").alias("columns"), "rows", F.coalesce("warning", F.lit("none")).alias("warning"))


@query
def a16_routing_adjustment(table):
    m = table("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("target"), F.when(F.col("l_linenumber") % 3 == 0, "weak").when(F.col("l_linenumber") % 3 == 1, "").otherwise(F.col("l_linestatus")).alias("reason"), F.col("l_discount").alias("penalty"))
    return RV.routing_adjustment(m)


@query
def a17_group_signals(table):
    g = table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("g"), F.col("l_linenumber").cast("string")).alias("group_id"), (F.col("l_returnflag") == "R").alias("ambiguous"), F.when(F.col("l_linenumber") != 2, F.col("l_tax") * 10).alias("group_confidence"), (F.col("l_discount") * 10).alias("selection_confidence"))
    return RV.group_signals(g)


@query
def a23_table_zones(table):
    e = table("events")
    at = e.select((F.col("event_id") % 97).alias("table"), F.col("event_id").alias("row"), F.posexplode(F.array(F.when(F.col("event_id") % 97 % 4 == 0, "X yes").otherwise(F.col("event_type")), F.when(F.col("event_id") % 97 % 3 != 0, F.col("value").cast("string")), F.when(F.col("event_id") % 97 % 5 == 0, "a rather long cell of text"))).alias("col", "value"))
    names = e.select((F.col("event_id") % 97).alias("table")).distinct().withColumn("names", F.array(F.when(F.col("table") % 2 == 0, "Is it so").otherwise("kind"), F.lit("value"), F.lit("a note")))
    return RV.table_zones(at, names)


@query
def f30_model_usage(table):
    body = F.when(F.col("event_id") % 5 == 0, F.lit('{"text": "no usage"}')).when(F.col("event_id") % 5 == 1, F.format_string('{"usage": {"prompt_tokens": "%d", "completion_tokens": 8, "precached_prompt_tokens": "3"}}', "user_id")).otherwise(F.format_string('{"usage": {"input_tokens": %d, "prompt_tokens": -1, "output_tokens": "x", "total_tokens": %d}}', "user_id", F.col("event_id") % 3))
    return RV.model_usage(table("events").select(F.col("event_id").alias("id"), body.alias("body")))


@query
def m11_sample_values(table):
    o = table("orders").withColumn("flag", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).otherwise(""))
    return RV.sample_values(o, "o_custkey", "o_orderkey", ["flag", "o_orderpriority"])


@query
def j13_run_context(table):
    """Orders as runs, their lines as versions and artifacts by line number; below zero customers as runs, their orders as both. Some orders have no line."""
    orders = table("orders")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("owner")).unionByName(table("customer").select((-F.col("c_custkey") - 1).alias("run_id"), F.col("c_nationkey").cast("long").alias("owner")))
    lines = table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("version"), F.col("l_returnflag").alias("state"), F.col("l_extendedprice").alias("price"))
    bought = orders.select((-F.col("o_custkey") - 1).alias("run_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"))
    made = lines.unionByName(bought).groupBy("run_id", "version")
    context = RV.run_context(runs, made.agg(F.min("state").alias("state")), made.agg(F.max("price").alias("price")))
    filled = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return context.select("run_id", "owner", filled("version", -1), filled("state", "none"), filled("price", -1.0))
