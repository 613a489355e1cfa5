"""Golden values: inputs and results that any implementation of these definitions must give."""

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import names as N
from fieldweave.functions import texts as T
from fieldweave.functions import values as V
from fieldweave.operators import evaluation as EV
from fieldweave.operators import extraction as X
from fieldweave.operators import feedback as FB
from fieldweave.operators import graph as G
from fieldweave.operators import layout as LY
from fieldweave.operators import learning as LE
from fieldweave.operators import matching as M
from fieldweave.operators import tables as TB


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "_ int")
    return row.select(column.alias("r")).first().r


@pytest.mark.parametrize("value,number", [("1 200", 1200.0), ("-3,5", -3.5), (" 7 ", 7.0), ("1.2.3", None), ("x1", None), ("", None)])
def test_numbers(spark, value, number):
    assert one(spark, V.parse_number(F.col("v")), v=value) == number


@pytest.mark.parametrize("value,day", [("31-12-2024", "2024-12-31"), ("31.12.2024", "2024-12-31"), ("2024-12-31", "2024-12-31"), ("31/12/2024", "2024-12-31"), ("2024/12/31", None), ("31.02.2024", None)])
def test_dates(spark, value, day):
    assert one(spark, V.parse_date(F.col("v")), v=value) == day


@pytest.mark.parametrize("value,repaired", [("12оооо", "120000"), ("5O0", "500"), ("|2s", "125"), ("—1,5", "-1.5"), ("2025-91-02", None), ("OO", "00"), ("abc", None)])
def test_repaired_numbers(spark, value, repaired):
    assert one(spark, V.repair_number(F.col("v")), v=value) == repaired


def test_repaired_dates_and_scripts(spark):
    assert one(spark, V.repair_date(F.col("v")), v="2025-91-02") is None
    assert one(spark, V.repair_date(F.col("v")), v="l.O2.2O25") == "2025-02-01"
    assert one(spark, V.repair_date(F.col("v")), v="2025/2/3") == "2025-02-03"
    assert one(spark, V.one_script(F.col("v")), v="Ивaнoв") == "Иванов" and one(spark, V.one_script(F.col("v")), v="Сopy") == "Copy"


@pytest.mark.parametrize("header,name", [("Сумма руб", "summaRub"), ("customerName", "customerName"), ("2 Name", "field2Name"), ("", "field"), ("Ёж (щит)", "ezhSchit"), (None, "field")])
def test_column_names(spark, header, name):
    assert one(spark, V.column_name(F.col("v")), v=header) == name


def pairs_of(spark, text):
    return [(r.label, r.value) for r in X.key_values(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("n").collect()]


def test_key_values(spark):
    assert pairs_of(spark, "Name: a\nname: b\nNAME: A") == [("Name", "a"), ("name", "b")]
    assert pairs_of(spark, None) == [] and pairs_of(spark, "no pair") == []
    line = "Full name Ivan Petrov, birth date 01.02.1990, phone +7 999 123-45-67, email a@b.cc, address Main street 1, document purpose visa."
    assert pairs_of(spark, line) == [("ФИО", "Ivan Petrov"), ("дата рождения", "01.02.1990"), ("телефон", "+7 999 123-45-67"), ("email", "a@b.cc"), ("адрес", "Main street 1"), ("цель документа", "visa")]


def test_two_tables_in_one_text(spark):
    text = "a\tb\tc\n1\t2\t3\n\nx\ty\tz\n4\t5\n6\t7\t8"
    got = X.delimited_tables(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("block").collect()
    assert [(r.doc_id, r.delimiter, r["columns"], r.rows) for r in got] == [(1, "\t", 3, 1), (1, "\t", 3, 2)]


@pytest.mark.parametrize("text,kind", [("a;b\n1;2\n\nsome text that is long", "mixed"), ("x y: z\nq r: s", "form"), ("only one: pair and some text", "text"), ("short", "image_like"), (None, "image_like")])
def test_document_kinds(spark, text, kind):
    assert X.document_kind(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().content_type == kind


def test_repeated_width_of_sixteen_cells(spark):
    row = ["deal_1", "Поставка оборудования", "2024-01-10", "переговоры", "1200,50", "ООО Ромашка", "Станок", "Иван Петров"]
    again = ["deal_2", "Другая поставка", "2024-02-11", "закрыта", "7", "АО Лютик", "Насос", "Анна Иванова"]
    cells = TB.flat_cells(spark.createDataFrame([(1, " | ".join(row + again)), (2, "a | b"), (3, None)], "doc_id long, text string"))
    assert [(r.doc_id, r.width) for r in TB.repeated_width(cells).collect()] == [(1, 8)]
    assert [r.name for r in TB.repeated_columns(cells).orderBy("column").collect()] == ["identifier", "name", "date", "stage", "amount", "organization", "product", "responsible"]


def test_recovered_rows_are_repaired_by_their_column(spark):
    rows = [("12оооо", "2025-01-02", "Ивaнов Иван"), ("5O0", "2025-91-02", "Петров"), ("7", "03.04.2025", "Сидоров")]
    cells = spark.createDataFrame([("t", k, v) for r in rows for k, v in enumerate(r)], "table string, col int, value string")
    got = {(r.col, r.value): (r.type, r.repaired) for r in TB.repaired_cells(cells).collect()}
    assert got[0, "12оооо"] == ("number", "120000") and got[0, "5O0"] == ("number", "500")
    assert got[1, "2025-91-02"] == ("date", "") and got[1, "03.04.2025"] == ("date", "2025-04-03") and got[2, "Ивaнов Иван"] == ("text", "Иванов Иван")


def test_zones(spark):
    for text, zone in (("СВЕДЕНИЯ О КЛИЕНТЕ БАНКА", "noise"), ("Name: x", "form"), ("[X] yes", "form"), ("Is it so?", "form"), ("just a line", "text"), (" ".join(["w"] * 18), "noise"), ("  ", "noise")):
        assert one(spark, T.line_zone(F.col("v")), v=text) == zone
    lines = [(1, 0, "text", "a", 1), (1, 0, "noise", "b", 1), (1, 1, "form", "c:", 1), (1, 1, "text", "d", 1), (1, 2, "text", "подпись", 1), (1, 3, "text", "e", 1), (1, 4, "text", "f " * 9, 9)]
    got = LY.region_zones(spark.createDataFrame(lines, "page int, region int, zone string, text string, words int"), "page")
    assert {(r.region, r.zone) for r in got.collect()} == {(0, "noise"), (1, "form"), (2, "noise"), (3, "text"), (4, "text")}


def test_header_scores():
    assert TB.header_score(["Name", "Total amount"], ["name", "amount"]) == 5 + 2 and TB.header_score([], ["a"]) == 0 and TB.header_score(["a_b"], ["A B", "ab c"]) == 7


def edges(spark, rows):
    return spark.createDataFrame(rows, "l string, r string, accepts long, rejects long, mean_confidence double, relation string")


def test_a_long_path_is_one_cluster(spark):
    path = [(f"n{k:03d}", f"n{k + 1:03d}", 1, 0, 1.0, "synonym") for k in range(120)]
    odd = [("x", "y", 0, 2, 1.0, "synonym"), ("n000", "z", 3, 0, 1.0, "conflict")]
    got = {r.node: r.cluster for r in G.clusters(edges(spark, path + odd)).collect()}
    assert len(got) == 121 and set(got.values()) == {"n000"}
    assert G.clusters(edges(spark, odd)).collect() == []


def log(spark, rows):
    return spark.createDataFrame([(k, None, u, s, t, a, c) for k, (u, s, t, a, c) in enumerate(rows)], "event_id long, ts timestamp, user_id long, source string, target string, accepted boolean, confidence double")


def test_promotion_and_sensitive_labels(spark):
    rows = [(1, "Дата создания клиента", "creationDate", True, 0.9), (1, "Дата создания клиента", "creationDate", True, 0.9), (2, "Дата создания клиента", "creationDate", True, 0.9)]
    mail = [(u, "Email клиента", "customerEmail", True, 0.9) for u in (1, 1, 2)]
    stats = {r.source: r for r in FB.promotion(FB.pattern_stats(log(spark, rows + mail))).collect()}
    good, bad = stats["Дата создания клиента"], stats["Email клиента"]
    assert (good.status, good.support, good.users, good.acceptance) == ("shared_promoted", 3, 2, 1.0)
    assert bad.status == "blocked_sensitive" and bad.sensitivity >= 0.6


def test_rare_tokens_add_to_the_risk(spark):
    stats = {r.source: r.sensitivity for r in FB.pattern_stats(log(spark, [(1, "zanzibarian amount", "amount", True, 0.9), (1, "commonplace amount", "amount", True, 0.9), (2, "commonplace amount", "amount", True, 0.9)])).collect()}
    assert stats == {"zanzibarian amount": 0.25, "commonplace amount": 0.0}


def test_staging(spark):
    rows = [(1, 7, None, "a", "x", "model_suggestion", s, 0.5) for s in ("accepted", "rejected", "suggested")]
    s = spark.createDataFrame(rows, "run_id long, user_id long, ts timestamp, source string, target string, truth string, status string, confidence double")
    assert [tuple(r) for r in LE.staging_counts(s).collect()] == [(7, 1, 1, 2)]
    r = LE.review_state(s).first()
    assert (r.total, r.accepted, r.rejected, r.pending, r.state) == (3, 1, 1, 1, "has_rejected_suggestions")


def case(spark, sources, targets):
    s = spark.createDataFrame([(1, k, x, None) for k, x in enumerate(sources)], "case_id long, source_pos long, source string, sample string")
    t = spark.createDataFrame([(1, k, x, "string") for k, x in enumerate(targets)], "case_id long, target_pos long, target string, type string")
    return s, t


EIGHT = {
    "actPlanDate": "Плановая дата акта",
    "closeReason": "Сделка - Причина закрытия",
    "closeReasonComment": "Сделка - Комментарий к причине закрытия",
    "creator": "Сделка - Создал",
    "dealId": "Сделка - ID сделки",
    "dealIdentifier": "Сделка - Идентификатор",
    "dealLastUpdateDate": "Сделка - Дата последнего обновления",
    "dealRevenueAmount": "Сделка - Сумма выручки",
}
TWENTY = {
    "dealStage": "Сделка - Стадия",
    "dealStageFinal": "Стадия (Сделка)",
    "dealStageTransitionDate": "Сделка - Дата перехода объекта на новую стадию",
    "deliveryType": "Тип поставки",
    "directSupply": "Сделка - Прямая поставка",
    "distributor": "Сделка - Дистрибьютор",
    "finalLicenseAmount": "Сделка - Итоговая сумма лицензий",
    "finalServiceAmount": "Сделка - Итоговая сумма услуг",
    "finalServiceAmountByRevenueWithVAT": "Сделка - Итоговая сумма услуг по выручке (с НДС)",
    "finalServiceAmountWithVAT": "Сделка - Итоговая сумма услуг (с НДС)",
    "forecast": "Сделка - Прогноз",
    "invoiceAmount": "Сумма акта",
    "invoiceAmountWithVAT": "Сумма акта (с НДС)",
    "marketingEvent": "Сделка - Маркетинговое мероприятие",
    "organization": "Сделка - Организация",
    "responsiblePerson": "Сделка - Ответственный",
    "siteLead": "Сделка - Лид с сайта",
    "stageTransitionTime": "Время перехода на текущую стадию",
    "totalProductAmount": "Сделка - Итоговая сумма продуктов",
    "unitOfMeasure": "Единица измерения",
}


@pytest.mark.parametrize("expected", [EIGHT, TWENTY])
def test_columns_of_a_deal_map_one_to_one(spark, expected):
    got = {r.target: r.source for r in M.assigned(M.pairs(*case(spark, list(expected.values()), list(expected)))).collect()}
    assert got == expected


def test_position_and_rules(spark):
    none = spark.createDataFrame([], "case_id long")
    got = M.by_position(*case(spark, ["1223", "hsdh", "sdvsdv"], ["customerName", "amount", "createdAt"]), none).collect()
    assert {(r.target, r.source, r.band) for r in got} == {("customerName", "1223", "low"), ("amount", "hsdh", "low"), ("createdAt", "sdvsdv", "low")}
    assert M.by_position(*case(spark, ["a"], ["x", "y"]), none).collect() == [] and M.by_position(*case(spark, ["a", "b"], ["x"]), none).collect() == []
    assert M.by_position(*case(spark, ["a"], ["x"]), spark.createDataFrame([(1,)], "case_id long")).collect() == []
    got = M.assigned(M.pairs(*case(spark, ["customer_name", "zzz"], ["customerName", "amount"]))).collect()
    assert [(r.target, r.source, r.band) for r in got] == [("customerName", "customer_name", "high")]


def test_conflict_lowers_a_models_confidence(spark):
    final = spark.range(1).select(M.final_confidence(F.lit(0.74), F.lit(0.5), F.lit(1.0)).alias("f"), M.final_confidence(F.lit(1.4), F.lit(None).cast("double"), F.lit(0.0)).alias("g")).first()
    assert final.f < 0.68 and final.g == 1.0
    reason = M.gate(F.lit("dealUpdateDate"), F.lit(False), F.lit("semantic_conflict_created_vs_updated"), F.lit("high"), F.lit(final.f))
    assert spark.range(1).select(reason.alias("r")).first().r == "semantic_conflict_created_vs_updated"


@pytest.mark.parametrize("values,kind,total,best", [(["n/a", "x", "second comment"], "string", 3, "second comment"), (["7701234567"], "number", 1, "7701234567"), (["n/a", "01.02.2025"], "string", 2, "2025-02-01"), (["maybe", "да"], "boolean", 2, "true"), (["a"], "string", 10, None), ([], "string", 3, None)])
def test_representatives(spark, values, kind, total, best):
    row = spark.createDataFrame([(values,)], "v array<string>")
    assert row.select(V.representative(F.col("v"), F.lit(kind), F.lit(total)).alias("r")).first().r == best


def test_wide_pairs_and_names(spark):
    p = "имя: Иван, город: Омск, тел: 1, a: 1, b: 2, c: 3, d: 4, e: 5"
    got = X.wide_pairs(spark.createDataFrame([(1, 1, p), (1, 2, p), (1, 3, "a: b"), (1, 4, None)], "doc_id long, row long, paragraph string")).collect()
    assert len(got) == 16 and {r.label for r in got} == {"имя", "город", "тел", "a", "b", "c", "d", "e"}
    names = spark.createDataFrame([(1, k, n) for k, n in enumerate(["a", "a", "a2", "a", "b"])], "g int, k int, name string")
    assert [r.unique for r in TB.unique_names(names, "g", "k", "name").orderBy("k").collect()] == ["a", "a2", "a22", "a3", "b"]
    assert one(spark, N.prepared(F.col("v"))["attribute"], v="productId") == "id"


def test_inline_profile_with_no_break_spaces(spark):
    line = "Это тестовый документ в одну строку: ФИО Иван Иванов, дата рождения 01.01.1990, телефон +7 999 123-45-67, email ivan.ivanov@example.com, адрес г. Москва, ул. Тестовая, д. 10, цель документа проверка обработки текста без переносов строк."
    want = [("ФИО", "Иван Иванов"), ("дата рождения", "01.01.1990"), ("телефон", "+7 999 123-45-67"), ("email", "ivan.ivanov@example.com"), ("адрес", "г. Москва, ул. Тестовая, д. 10"), ("цель документа", "проверка обработки текста без переносов строк")]
    assert pairs_of(spark, line) == want and pairs_of(spark, line.replace(" ", "\u00a0")) == want


def test_paragraphs_of_pairs_make_a_table_from_two_rows_on(spark):
    deals = ["dealId: DEAL_12345, dealName: Проект Alpha, creationDate: 2025-07-15, stage: Переговоры, organization: ООО Организация", "dealId: DEAL_67890, dealName: Проект Beta, stage: Закрыта успешно, organization: ООО Техно, manager: Сидоров"]
    made = lambda rows: X.wide_pairs(spark.createDataFrame(rows, "doc_id long, row long, paragraph string")).orderBy("row", "place").collect()
    got = made([(1, k, d) for k, d in enumerate(deals)])
    assert [r.label for r in got[:6]] == ["dealId", "dealName", "creationDate", "stage", "organization", "manager"]
    assert [r.value for r in got[:6]] == ["DEAL_12345", "Проект Alpha", "2025-07-15", "Переговоры", "ООО Организация", ""] and got[8].value == ""
    assert made([(1, 0, deals[0])]) == []


def test_facts_of_two_languages(spark):
    text = "The fee is 5 EUR. Ставка составляет 7 процентов.\nthe FEE is 5 eur\nСумма равна 10. : is nothing. Итог является верным"
    got = X.text_facts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.label, r.value) for r in got] == [("The fee", "5 EUR"), ("Ставка", "7 процентов"), ("Сумма", "10"), ("Итог", "верным")]


def test_many_facts_of_one_document_stay_linear(spark):
    import time

    df = spark.createDataFrame([(1, ". ".join(f"Thing{k} is value{k}" for k in range(20_000)))], "doc_id long, text string")
    X.text_facts(df).collect()
    began = time.time()
    assert len(X.text_facts(df, limit=100).collect()) == 100 and time.time() - began < 10


def test_sections_and_blocks(spark):
    text = "intro\nmore\n\nCOVER PAGE\n\nTerms:\n\nfirst\n\nsecond\n\nTHE END"
    docs = spark.createDataFrame([(1, text), (2, "ONE:\n\nTWO:\n\nTHREE:\n\nFOUR:"), (3, None), (4, "\n\n".join(f"H{k}:\n\nbody" for k in range(20)))], "doc_id long, text string")
    got = X.sections(docs).orderBy("doc_id", "section").collect()
    assert [(r.section, r.title, r.text) for r in got if r.doc_id == 1] == [(1, "Document", "intro\nmore"), (2, "Terms:", "first\n\nsecond")]
    assert [(r.title, r.text) for r in got if r.doc_id == 2] == [("Document", "ONE:\n\nTWO:\n\nTHREE:")]
    assert not [r for r in got if r.doc_id == 3] and [r.section for r in got if r.doc_id == 4] == list(range(1, 13))
    blocks = X.text_blocks(docs).orderBy("doc_id", "n").collect()
    assert [(r.n, r.label) for r in blocks if r.doc_id == 1] == [(1, None), (2, "COVER PAGE"), (3, "Terms:"), (4, None), (5, None), (6, "THE END")]
    assert len([r for r in blocks if r.doc_id == 4]) == 24


def test_header_names_and_labels(spark):
    cells = spark.createDataFrame([(1, k, n) for k, n in enumerate(["Sum", " sum ", None, "SUM", "", "sum_2"])], "t int, k int, name string")
    assert [r.unique for r in TB.header_names(cells, "t", "k", "name").orderBy("k").collect()] == ["Sum", "sum_2", "column_3", "SUM_3", "column_5", "sum_2"]
    labels = spark.createDataFrame([(g, k, n) for g in (1, 2) for k, n in enumerate(["a", "a", "a 2", "a"])], "t int, k int, name string")
    assert [r.unique for r in TB.unique_names(labels, "t", "k", "name", " ").orderBy("t", "k").collect()] == ["a", "a 2", "a 2 2", "a 3"] * 2


def test_feature_bags_count_and_are_bounded(spark):
    runs = spark.createDataFrame([(1, ["a"] * 3 + [f"s{k}" for k in range(60)], ["a"], 5, 1, 1, 0, 0, 1, 0, "csv")], "id long, sources array<string>, targets array<string>, rows long, sheets int, high int, medium int, low int, none int, warnings int, file_type string")
    r = EV.feature_vectors(runs).first()
    assert r.tokens["source:a"] == 3 and len(r.tokens) == 46 + 1 + 1 and r.vector[4] == round(1 / 61, 6)


def test_examples_ask_for_drafts_and_mappings(spark):
    items = spark.createDataFrame([(1, "correction", "train", 0.9, '{"a":1}', '{"b":2}'), (2, "template", "train", 0.9, "[1]", '{"draft_json":{"c":3}}'), (3, "mapping", "train", 0.9, '"x"', "7")], "id long, item_kind string, split string, quality_score double, input_payload string, target_payload string")
    got = {r.id: r for r in EV.training_examples(items).collect()}
    assert got[1].task_type == "mapping" and [m.content for m in got[1].messages[1:]] == ['{"a":1}', '{"b":2}']
    assert got[2].task_type == "draft_json" and [m.content for m in got[2].messages[1:]] == ['{"raw_input":[1]}', '{"c":3}'] and got[2].messages[0].content.startswith("Generate a canonical draft")
    assert [m.content for m in got[3].messages[1:]] == ['{"raw_input":"x"}', '{"raw_target":7}']


def test_repeated_columns_join_nothing(spark):
    """Each list's widths and columns are told by windows over it: nothing of all lists is sent to the driver, and from there to all."""
    cells = TB.flat_cells(spark.createDataFrame([(k, f"deal_{k} | 2024-01-10 | deal_{k + 1} | 2024-02-1{k % 10} | deal_x | 2024-03-01") for k in range(50)], "doc_id long, text string"))
    for found in (TB.repeated_width(cells), TB.repeated_columns(cells)):
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.width) for r in TB.repeated_width(cells).collect()} == {(k, 2) for k in range(50)}
    assert {tuple(r) for r in TB.repeated_columns(cells).collect()} == {x for k in range(50) for x in ((k, 0, "identifier"), (k, 1, "date"))}
