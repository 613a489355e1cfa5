"""Continued tables, nearest headers, page columns and sections by example."""

import random

from pyspark.sql import functions as F

from fieldweave.operators import page_tables as P

TEXT, CODE = "Наименование видов операций", "Код вида операций"
SHEETS = [
    (1, [TEXT, CODE], [["Операции с денежными средствами в наличной форме:", "1000"], ["Покупка наличной иностранной валюты физическим лицом", "1003"]]),
    (2, ["Продажа наличной иностранной валюты физическим лицом", "1004"], [["Приобретение физическим лицом ценных бумаг за наличный расчёт", "1005"]]),
    (3, ["Посторонний текст страницы", "column2"], [["Получение физическим лицом денежных средств по чеку на предъявителя, выданному нерезидентом", "1006"]]),
]


def tables(spark, sheets, doc=1):
    heads = spark.createDataFrame([(doc, n, c) for n, c, _ in sheets], "doc_id long, sheet long, columns array<string>")
    return heads, spark.createDataFrame([(doc, n, k, v) for n, _, rows in sheets for k, v in enumerate(rows)], "doc_id long, sheet long, row long, values array<string>")


def test_continued_tables_of_codes(spark):
    got = P.continued_rows(*tables(spark, SHEETS)).orderBy("sheet", "row").collect()
    assert [(r.text, r.code) for r in got] == [("Покупка наличной иностранной валюты физическим лицом", "1003"), ("Продажа наличной иностранной валюты физическим лицом", "1004"), ("Приобретение физическим лицом ценных бумаг за наличный расчёт", "1005"), ("Получение физическим лицом денежных средств по чеку на предъявителя, выданному нерезидентом", "1006")]
    assert {(r.text_header, r.code_header) for r in got} == {(TEXT, CODE)}
    assert P.continued(*tables(spark, SHEETS)).count() == 5


def test_one_table_is_not_continued(spark):
    assert P.continued(*tables(spark, SHEETS[:1])).collect() == [] and P.continued(*tables(spark, [(1, ["a"], [["b"]]), (2, [], [])])).collect() == []
    twice = [SHEETS[0], (2, [CODE, TEXT], [["1003", SHEETS[0][2][1][0]], [None, "x y"], ["7", None]])]
    assert [(r.sheet, r.code) for r in P.continued(*tables(spark, twice)).orderBy("code").collect()] == [(1, "1000"), (1, "1003")]


def test_headings_go_only_beside_codes(spark):
    heads, rows = tables(spark, [(1, [TEXT, CODE], [["Глава:", "1000"], ["Глава:", "см. ниже"], ["x", "12"]]), (2, ["a", "b"], [["Глава:", "слово"]])])
    assert [(r.sheet, r.row) for r in P.without_headings(heads, rows).orderBy("sheet", "row").collect()] == [(1, 1), (1, 2), (2, 0)]


def test_cells_go_under_the_nearest_header(spark):
    headers = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 100.0, 20.0), (1, 2, 200.0, None), (1, 3, None, 5.0)], "table_id long, pos long, x double, width double")
    cells = [(1, 1, 0, 5.0, 10.0, "a"), (1, 1, 1, 40.0, 10.0, "b"), (1, 1, 2, 60.0, 10.0, "tie"), (1, 1, 3, 190.0, 0.0, " c "), (1, 1, 4, 999.0, None, "d"), (1, 2, 5, 110.0, 2.0, ""), (1, 2, 6, None, 2.0, "lost"), (2, 1, 0, 5.0, 1.0, "no header")]
    got = P.under_headers(headers, spark.createDataFrame(cells, "table_id long, row long, pos long, x double, width double, text string")).collect()
    assert {(r.row, r.header, r.text) for r in got} == {(1, 0, "a b tie"), (1, 2, "c d")}


def test_nearest_headers_equal_brute_force(spark):
    rnd = random.Random(2)
    headers = [(t, k, float(rnd.randrange(100)), float(rnd.randrange(4))) for t in range(5) for k in range(rnd.randrange(1, 7))]
    cells = [(t, k // 9, k, float(rnd.randrange(-20, 130)), float(rnd.randrange(9)), f"w{k}") for t in range(6) for k in range(90)]
    want = {}
    for t, row, _, x, w, text in cells:
        own = [(abs(hx + hw / 2 - x - w / 2), k) for ht, k, hx, hw in headers if ht == t]
        if own:
            want.setdefault((t, row, min(own)[1]), []).append(text)
    got = P.under_headers(spark.createDataFrame(headers, "table_id long, pos long, x double, width double"), spark.createDataFrame(cells, "table_id long, row long, pos long, x double, width double, text string"))
    assert {(r.table_id, r.row, r.header): r.text for r in got.collect()} == {k: " ".join(v) for k, v in want.items()}


def test_columns_of_a_page(spark):
    lines = spark.createDataFrame([(1, x) for x in (20.0, 56.0, 470.0, 140.0, 141.0, 300.0, None)] + [(2, None)], "page_id long, x0 double")
    assert {(r.page_id, r.x0): r.column_id for r in P.page_columns(lines).collect()} == {(1, 20.0): 1, (1, 56.0): 1, (1, 140.0): 2, (1, 141.0): 2, (1, 300.0): 3, (1, 470.0): 4, (1, None): None, (2, None): None}


def test_sections_name_their_groups(spark):
    sections = spark.createDataFrame([(1, 1, "Part", "text. Is it SO, now? more"), (1, 2, None, "x"), (1, 3, " ", " ")], "doc_id long, n long, title string, text string")
    groups = spark.createDataFrame([(1, 5, "b", "is it so now"), (1, 2, "a", "so"), (1, 9, "c", "other"), (2, 1, "d", "q"), (2, 0, "e", "r")], "doc_id long, pos long, group_id string, question string")
    got = {(r.doc_id, r.section_id): (r.title, r.group_ids) for r in P.section_groups(sections, groups).collect()}
    assert got == {(1, "section_1"): ("Part", ["a", "b"]), (1, "section_2"): ("Section 2", []), (2, "section_form_root"): ("Form Body", ["e", "d"])}
    assert P.section_groups(sections.limit(0), groups.limit(0)).where(F.lit(True)).collect() == []
