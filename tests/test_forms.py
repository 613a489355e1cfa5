"""Forms by example: the rows, lines and pairs that any reading of forms must tell apart."""

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import form_texts as T
from fieldweave.operators import form_model as M

ROW = "doc_id long, table_idx long, row_idx long, cells array<string>, paragraphs array<array<string>>"
LINE = "doc_id long, pos long, text string, source string, page long, line_id string, block_id string, paragraph_idx long, table_idx long, row_idx long, cell_idx long"
REF = "struct<page:long,line_id:string,block_id:string,paragraph_idx:long,table_idx:long,row_idx:long,cell_idx:long>"
NOWHERE = "Не являюсь налоговым резидентом ни в одном государстве"
ASKS = "Является ли выгодоприобретатель налоговым резидентом только в РФ"


def rows(spark, cells, paragraphs=None):
    made = [(1, 0, k, c, (paragraphs or {}).get(k, [[x] for x in c])) for k, c in enumerate(cells)]
    return spark.createDataFrame(made, ROW)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


def said(groups):
    return {r.question: (r.group_id, r.group_type, [(o.label, o.selected) for o in r.options]) for r in groups.collect()}


def test_a_form_in_a_table(spark):
    form = rows(spark, [
        ["Наименование организации", 'ООО "Рога и копыта"'], ["ИНН/КИО", "1234567890"], [ASKS, ""], [" ", "ДА"], ["X", NOWHERE], [" ", "НЕТ, является налоговым резидентом в иностранном государстве"],
        ["FATCA статус выгодоприобретателя", ""], ["X", "Иностранным финансовым институтом"], ["", ""],
    ])
    assert [(r.label, r.value) for r in M.table_scalars(form).orderBy("pos").collect()] == [("Наименование организации", 'ООО "Рога и копыта"'), ("ИНН/КИО", "1234567890")]
    got = said(M.table_groups(form))
    assert got == {f"{ASKS} ДА": ("tax_residency", "single_choice", [(NOWHERE, True), ("Иностранным финансовым институтом", True)])}


def test_groups_end_where_scalars_and_lists_stand(spark):
    q = "Which of these answers is the right one?"
    form = rows(spark, [["X", "early"], [q, ""], ["Label", "text"], ["see the note", ""], ["X", "a1"], ["☐", "b2"], ["Label", "sum"], ["X", "late"], ["X", "later"], [q, "X yes; no"], ["V", "after"], [q, "plain"]])
    got = {r.pos: (r.question, r.group_type, [(o.label, o.selected) for o in r.options]) for r in M.table_groups(form).collect()}
    assert got == {
        0: (M.UNKNOWN, "single_choice", [("early", True)]), 1: (f"{q} see the note", "single_choice", [("a1", True), ("b2", False)]),
        7: (M.UNKNOWN, "multi_choice", [("late", True), ("later", True)]), 9: (q, "single_choice", [("yes; no", True)]), 10: (M.UNKNOWN, "single_choice", [("after", True)]),
    }


def test_lists_in_a_cell(spark):
    q = "Является ли хотя бы одно из следующих утверждений верным"
    form = rows(spark, [[q, "x"]], {0: [[q], ["X Я лицо FATCA;", "второе;", "Второе", " ;"]]})
    assert said(M.table_groups(form)) == {q: ("fatca_beneficiary", "multi_choice", [("Я лицо FATCA", True), ("второе", False)])}


def test_lines_and_cells_give_scalars(spark):
    cell = lambda row, k, text: (1, row * 10 + k, text, "table_cell", None, None, None, None, 0, row, k)
    lines = [
        cell(1, 0, "Наименование организации"), cell(1, 1, "ООО «Рога и Копыта»"), cell(2, 0, "ИНН/КИО"), cell(2, 1, "1234567890"), cell(4, 0, "Российской Федерации?"),
        cell(4, 1, "X Не являюсь налоговым резидентом ни в одном государстве (территории)"), cell(5, 0, "СВЕДЕНИЯ О ВЫГОДОПРИОБРЕТАТЕЛЕ"), cell(5, 1, "ЮРИДИЧЕСКОМ ЛИЦЕ или ИНОСТРАННОЙ СТРУКТУРЕ БЕЗ"),
        (1, 90, "Дата : 01.02.2025", "paragraph", None, None, None, 3, None, None, None), (1, 91, "настоящее согласие предоставляется на совершение следующих действий с персональными данными: передача", "paragraph", None, None, None, 4, None, None, None), (1, 92, None, "paragraph", None, None, None, 5, None, None, None),
    ]
    got = {(r.label, r.value, r.confidence) for r in M.line_scalars(spark.createDataFrame(lines, LINE)).collect()}
    assert got == {("Наименование организации", "ООО «Рога и Копыта»", "medium"), ("ИНН/КИО", "1234567890", "medium"), ("Дата", "01.02.2025", "high")}


def scalars(spark, items):
    made = [(1, k, label, value, "medium", "line", ref) for k, (label, value, ref) in enumerate(items)]
    return spark.createDataFrame(made, f"doc_id long, pos long, label string, value string, confidence string, source string, ref {REF}")


def test_groups_consume_scalars(spark):
    yes, no = "ДА, является налоговым резидентом только в РФ", "НЕТ, является налоговым резидентом в следующем(их) иностранном(ых)"
    form = rows(spark, [["", ""], ["", ""], [f"{ASKS}?", ""], ["X", yes], ["X", "Не являюсь налоговым резидентом"], ["☐", no]])
    row = lambda r: (None, None, None, None, 0, r, None)
    given = scalars(spark, [("Наименование", "ООО", row(1)), (yes, yes, None), ("x", no.upper(), row(77)), ("Note", "1", row(4)), ("Note", "2", (3, "l", None, None, None, None, None)), (f"{ASKS}", "v", None), ("note ", "1", None)])
    kept = M.unconsumed(M.distinct_scalars(given), M.distinct_groups(M.table_groups(form)))
    assert [(r.label, r.value) for r in kept.orderBy("pos").collect()] == [("Наименование", "ООО"), ("Note", "2")]


def overlap(a, b):
    """The rule spelled out: a shared line, block, paragraph or cell within the same row or page, else the same row, else the same line of a page."""
    def parent():
        if None not in (a["table_idx"], b["table_idx"], a["row_idx"], b["row_idx"]):
            return a["table_idx"] == b["table_idx"] and a["row_idx"] == b["row_idx"]
        return a["page"] == b["page"] if None not in (a["page"], b["page"]) else True

    if any(a[c] is not None and a[c] == b[c] and parent() for c in ("line_id", "block_id", "paragraph_idx", "cell_idx")):
        return True
    if None not in (a["table_idx"], b["table_idx"], a["row_idx"], b["row_idx"]):
        return a["table_idx"] == b["table_idx"] and a["row_idx"] == b["row_idx"]
    return None not in (a["page"], b["page"], a["line_id"], b["line_id"]) and a["page"] == b["page"] and a["line_id"] == b["line_id"]


def test_overlap_of_places_is_a_common_key(spark):
    import random

    rnd = random.Random(5)
    pick = lambda name: {c: None if rnd.random() < 0.6 else (str(rnd.randrange(2)) if c.endswith("_id") else rnd.randrange(2)) for c in M.REF}
    pairs = [(k, pick("a"), pick("b")) for k in range(600)]
    df = spark.createDataFrame([(k, tuple(a.values()), tuple(b.values())) for k, a, b in pairs], f"k int, a {REF}, b {REF}")
    got = {r.k: r.hit for r in df.select("k", F.arrays_overlap(M._ref_keys("a", True), M._ref_keys("b", False)).alias("hit")).collect()}
    assert got == {k: overlap(a, b) for k, a, b in pairs} and 50 < sum(got.values()) < 550


def test_scores(spark):
    group = lambda kind, marks: (1, 0, "g", "Q", kind, None, [(f"o{k}", m != "", m, None) for k, m in enumerate(marks)])
    df = spark.createDataFrame([group("single_choice", ["X", ""]), group("single_choice", ["X", "X"]), group("multi_choice", ["", ""])], f"doc_id long, pos long, group_id string, question string, group_type string, ref {REF}, options array<struct<label:string,selected:boolean,marker:string,ref:{REF}>>")
    assert [(r.group_score, r.choice_score, r.ambiguous) for r in M.scored_groups(df).collect()] == [(0.95, 0.95, False), (0.8, 0.25, True), (0.8, 0.35, False)]


def test_fragments_of_groups_go(spark):
    form = rows(spark, [[f"{ASKS}?", ""], ["X", "Не являюсь налоговым резидентом"]])
    pairs = spark.createDataFrame([(1, "Да", f"{ASKS}?  "), (1, "Ответ", f"{ASKS}?"), (1, "Статус", "не являюсь  налоговым резидентом РФ"), (1, None, None), (2, "Да", f"{ASKS}?")], "doc_id long, label string, value string")
    got = {(r.doc_id, r.label) for r in M.without_fragments(pairs, M.table_groups(form)).collect()}
    assert got == {(1, "Ответ"), (1, None), (2, "Да")}


def test_empty_forms(spark):
    none = rows(spark, [["", " "]])
    assert M.table_groups(none).collect() == [] and M.table_scalars(none.limit(0)).collect() == []
    assert M.unconsumed(M.distinct_scalars(scalars(spark, [("a", "b", None)])), M.table_groups(none)).count() == 1


@pytest.mark.parametrize("text,option,question,heading", [("X yes", ("yes", True), False, False), ("[ ] no", ("no", False), False, False), ("Да, согласен", None, False, False), ("Кто вы такой?", None, True, False), ("СВЕДЕНИЯ о лице", None, False, True), ("A B C D", None, False, True), ("", None, False, False), (None, None, False, False)])
def test_what_a_line_is(spark, text, option, question, heading):
    df = spark.createDataFrame([(text,)], "v string")
    r = df.select(T.option(F.col("v")).alias("o"), F.coalesce(T.is_question(F.col("v")), F.lit(False)).alias("q"), F.coalesce(T.is_heading(F.col("v")), F.lit(False)).alias("h")).first()
    assert ((r.o.label, r.o.selected) if r.o else None, r.q, r.h) == (option, question, heading)
