import corpus_pipeline as C
from fieldweave.llm.workspace import stored

SF = "/root/testdata/sf0.01"


def test_each_stage_acts_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, held = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in C.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        held.append({r.doc_id: r.text for r in docs.collect()})
        assert set(held[-1]) <= set(held[-2]) and len(held[-1]) > 0.6 * len(held[-2])
    raw, good, single, cut, clean = held
    dropped = [labels[i] for i in set(raw) - set(good) if i in labels]
    assert sum(not r.quality or r.toxic for r in dropped) > 0.9 * len(dropped) > 0
    assert all(single[i] == good[i] for i in single) and len(set(single.values())) == len(single)
    assert 0 < sum(cut[i] != single[i] for i in cut) < 0.4 * len(cut)
    gone = set(cut) - set(clean)
    whole = [r.text for r in bench.collect()]
    assert gone and not [i for i, t in clean.items() for b in whole if b in t]
    got = {r.doc_id: r for r in C.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(got) == set(clean) and all(r.round_trip for r in got.values())


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_nulls_and_repeated_rows_survive_every_stage(spark):
    text = " ".join(f"the w{k} and" for k in range(30))
    rows = [(1, text, None, None, None), (1, text, "en", "s", 5), (None, text + " more", "en", "s", 5), (2, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[1:-1]:
        df = stored(stage(spark, df, SF), name)
    assert sorted((r.doc_id or 0, r.text or "") for r in df.collect()) == [(0, text + " more"), (1, text), (1, text), (2, "")]
