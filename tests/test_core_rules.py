"""Golden values of the core operators on small tables."""

import io
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import names as N
from fieldweave.functions import values as V
from fieldweave.operators import drafts as DR
from fieldweave.operators import feedback as FB
from fieldweave.operators import forms as FM
from fieldweave.operators import layout as LY
from fieldweave.operators import matching as M
from fieldweave.operators import transform as TR
from fieldweave.plans import sample_log as SL
from fieldweave.sources import readers as R
from fieldweave.streaming import feedback_stream as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name,entity,attribute,role", [("user_id", "user", "id", "identifier"), ("productId", "product", "id", "identifier"), ("id", None, "id", "identifier"), ("Дата создания клиента", "date", "created", "timestamp"), ("", None, None, None)])
def test_semantic_parts(spark, name, entity, attribute, role):
    p = one(spark, name, N.prepared)
    assert (p.attribute, p.role) == (attribute, role) and (p.entity == entity or name.startswith("Дата"))


def test_names_are_normal_in_any_spelling(spark):
    assert one(spark, "CustomerName2", N.prepared).tokens == ["customer", "name", "2"]
    assert one(spark, "ФИО клиента", N.prepared).canonical == ["name", "customer"]
    again = one(spark, "total amount", N.prepared).normalized
    assert one(spark, again, N.prepared).normalized == again


@pytest.mark.parametrize("text,number,kind", [("1 200,5", 1200.5, "number"), ("1_000", None, "string"), ("abc", None, "string"), ("", None, "null"), (None, None, "null"), ("нет", None, "boolean"), ("on 2024-01-02", None, "date"), ("12", 12.0, "number")])
def test_values(spark, text, number, kind):
    assert one(spark, text, V.to_number) == number and one(spark, text, V.value_type) == kind


def test_repair_and_dates(spark):
    assert one(spark, "12оооо", V.repair_number) == "120000" and one(spark, "5O0", V.repair_number) == "500"
    assert one(spark, "31.12.2024", V.parse_date) == "2024-12-31" and one(spark, "2025-91-02", V.parse_date) is None


@pytest.mark.parametrize("bad", ['{"name":"","name":1}', '{"":""}', '{"items":[1,"two"]}', '[{"a":1},{"a":"x"}]'])
def test_bad_targets(bad):
    with pytest.raises(ValueError):
        TR.target_fields(bad)


def test_targets():
    assert TR.target_fields('[{"name":"","amount":0}]') == [("name", "string", True), ("amount", "number", True)]
    assert [f[0] for f in TR.target_fields('[{"param":{"id":"","name":"","descr":"","createDate":""}}]')] == ["param.id", "param.name", "param.descr", "param.createDate"]
    assert TR.target_fields('{"input":[{"b":1},{"a":"","b":null,}]}') == [("a", "string", False), ("b", "number", True)]
    assert "name: string;" in TR.typescript(TR.target_fields('{"user":{"name":""}}'))


def test_transform_keeps_what_did_not_fit(spark):
    fields = TR.target_fields('{"name":"","amount":0,"active":true}')
    rows = spark.createDataFrame([("Alice", "10"), ("Bob", "x")], "name string, amount string")
    out = TR.transformed(rows, {"name": "name", "amount": "amount"}, fields)
    assert [(r.name, r.amount, r.active) for r in out.collect()] == [("Alice", 10.0, None), ("Bob", None, None)]
    assert sorted((r.path, r.code) for r in TR.diagnostics(out, fields).collect()) == [("active", "missing_required_field")] * 2 + [("amount", "type_mismatch")]
    with pytest.raises(ValueError):
        TR.transformed(rows, {}, [("a", "string", True), ("a.b", "string", True)])


def test_assignment_uses_each_source_once(spark):
    s = spark.createDataFrame([(1, 0, "customer_name", ""), (1, 1, "client name", ""), (1, 2, "zzz", "")], "case_id long, source_pos long, source string, sample string")
    t = spark.createDataFrame([(1, 0, "customerName", "string"), (1, 1, "buyerTitle", "string"), (1, 2, "amount", "number")], "case_id long, target_pos long, target string, type string")
    got = {r.target: (r.source, r.band) for r in M.assigned(M.pairs(s, t)).collect()}
    assert got == {"customerName": ("customer_name", "high"), "buyerTitle": ("client name", "high")}
    top = [r for r in M.scored(M.pairs(s, t)).collect() if r.rank == 1 and r.target == "customerName"]
    assert top[0].source == "customer_name" and 0 <= top[0].score <= 1
    assert one(spark, "ab", lambda x: M.ratio(x, F.lit("abc"))) == SequenceMatcher(None, "ab", "abc").ratio()


def test_promotion_gates(spark):
    log = [(k, k % 2, "Дата создания клиента", "creationDate", True, 0.9) for k in range(4)] + [(9, 1, "Email клиента", "customerEmail", True, 0.9), (10, 1, "summary", "amount", True, 0.9)]
    df = spark.createDataFrame(log, "event_id long, user_id long, source string, target string, accepted boolean, confidence double").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.source: (r.status, r.reason) for r in FB.promotion(FB.pattern_stats(df)).collect()}
    assert got["Дата создания клиента"] == ("shared_promoted", "stable_generalized_pattern")
    assert got["Email клиента"][0] == "blocked_sensitive" and got["summary"] == ("personal_only", "insufficient_accepts")
    m = FB.memory(df).where("user_id = 1 and source like 'Дата%'").first()
    assert (m.usage_count, m.success_count, m.last_accepted) == (2, 2, True)


def test_row_bands_follow_the_running_mean(spark):
    b = spark.createDataFrame([(1, k, float(k), y, 10.0) for k, y in enumerate([0.0, 8.0, 12.0, 40.0])], "page long, id long, x double, y double, height double")
    assert {r.id: r.band for r in LY.row_bands(b).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("ФИО;Сумма\nИванов;10\nПетров;20\n".encode("cp1251"))
    got = R.read_cells(spark, str(tmp_path), "csv").collect()
    assert [(r.row, r.name, r.value) for r in got] == [(0, "ФИО", "Иванов"), (0, "Сумма", "10"), (1, "ФИО", "Петров"), (1, "Сумма", "20")]
    assert R._cells("p", "t", [["a", " "], ["1"]]) == [("p", "t", 0, 0, "a", "1"), ("p", "t", 0, 1, "Column 2", None)]
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Jan" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1223</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5.0</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(raw.getvalue())
    cells = R.read_cells(spark, str(tmp_path), "xlsx")
    assert [(r.table, r.name, r.value) for r in cells.collect()] == [("Jan", "name", "Ann"), ("Jan", "1223", "5")]
    assert R.as_table(cells, ["name", "1223"]).select("name", "1223").first() == ("Ann", "5")
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        row = lambda *v: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in v) + "</w:tr>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:tbl>{row("a", "")}{row("1", "2")}</w:tbl></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(raw.getvalue())
    assert [(r.name, r.value) for r in R.read_cells(spark, str(tmp_path), "docx").collect()] == [("a", "1"), ("Column 2", "2")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    log = S.log_stream(spark, f"{tmp_path}/in", events)
    q = S.pattern_counts(log).writeStream.outputMode("complete").format("memory").queryName("patterns").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(180)
    batch = S.pattern_counts(SL.correction_log(events))
    rounded = lambda df: sorted((r.source, r.target, r.support, r.accepts, round(r.confidence, 6)) for r in df.collect())
    assert rounded(spark.table("patterns")) == rounded(batch)
    w = S.acceptance(log).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    w.awaitTermination(180)
    whole = {(r.from_ts, r.source): (r.accepts, r.n) for r in S.acceptance(SL.correction_log(events)).collect()}
    got = {(r.from_ts, r.source): (r.accepts, r.n) for r in spark.table("windows").collect()}
    assert got and set(got) <= set(whole)


def test_cascade_prefers_tiers_and_keeps_rules_sources_free(spark):
    rows = [
        (1, 0, "first", "a", "personal_memory", 0.9),
        (1, 0, "first", "b", "global_pattern", 0.8),
        (1, 1, "second", "a", "deterministic", 0.9),
        (1, 2, "third", "c", "global_pattern", 0.5),
        (1, 3, "fourth", "d", "semantic_graph", 0.8),
    ]
    df = spark.createDataFrame(rows, "case_id long, target_pos long, target string, source string, tier string, score double")
    got = {r.target: (r.source, r.tier) for r in DR.cascade(df).collect()}
    assert got == {"first": ("b", "global_pattern"), "second": ("a", "deterministic"), "fourth": ("d", "semantic_graph")}


def test_forms(spark):
    lines = ["[ ] before", "Residence?", "of the client", "[x] NO", "☐ YES", "text", "[ ] later"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "doc_id long, pos int, line string")
    g = FM.groups(df)
    assert sorted((r.option, r.selected) for r in g.collect()) == [("NO", True), ("YES", False), ("before", False), ("later", False)]
    assert {r.question for r in g.collect()} == {"Unknown question", "Residence? of the client"}
    a = FM.answers(g, {"no": "NOWHERE"}).where("question <> 'Unknown question'").first()
    assert (a.kind, a.answer, a.confidence) == ("single", "NOWHERE", 0.92)
    w = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 3.0, 1.0), (1, 3, 9.0, 0.0)], "page long, id long, top double, x0 double")
    assert {r.id: r.line for r in FM.lines_of(w).collect()} == {1: 0, 2: 0, 3: 1}
