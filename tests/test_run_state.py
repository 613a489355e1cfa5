"""Suggestions, promotion and versions of runs by example; the stream of a log gives the same states as its replay."""

from fieldweave.operators import learning as LE
from fieldweave.operators import run_state as R
from fieldweave.plans import sample_log as SL

MAPPING = "run_id long, pos long, user_id long, source string, target string, band string, reason string, status string, truth string"


def mapping(run, pos, source="a b", target="x", band="high", status=None, truth="deterministic_rule"):
    return (run, pos, 1, source, target, band, "r", status, truth)


def test_suggestions(spark):
    rows = [mapping(1, 0, "User Id", " accountId "), mapping(1, 1, "", "y", "low", None, None), mapping(1, 2, None, " "), mapping(None, 3), mapping(1, 4, status="rejected", band="none")]
    got = {r.pos: r for r in R.suggestions(spark.createDataFrame(rows, MAPPING)).collect()}
    assert set(got) == {0, 1, 4} and (got[0].source_name, got[0].target, got[0].target_name, got[0].confidence, got[0].status) == ("userid", "accountId", "accountid", 0.95, "accepted")
    assert (got[1].source, got[1].source_name, got[1].confidence, got[1].status, got[1].truth) == (None, None, 0.4, "suggested", "model_suggestion")
    assert (got[4].confidence, got[4].status) == (None, "rejected")
    bands = {r.pos: r.band for r in R.canonical(R.suggestions(spark.createDataFrame(rows, MAPPING)), spark.createDataFrame([mapping(1, 9), mapping(2, 8, band="medium")], MAPPING)).collect()}
    assert bands == {0: "high", 1: "low", 4: "none", 8: "medium"}


#: suggestions, mappings of a run without any, and what its promotion says
RUNS = [
    ([mapping(1, 0), mapping(1, 1, status="rejected"), mapping(1, 2, band="low")], [], False, "has_rejected_suggestions"), ([mapping(2, 0), mapping(2, 1, band="low")], [], False, "has_pending_suggestions"), ([mapping(3, 0, None, band="low")], [], True, None),
    ([], [mapping(4, 0)], True, None), ([], [mapping(5, 0, truth="position_fallback")], False, "generation_not_confirmed"), ([], [mapping(6, 0), mapping(6, 1, status="suggested")], False, "generation_not_confirmed"), ([], [], False, "generation_not_confirmed"), ([mapping(8, 0)], [], True, "already_promoted"),
]


def test_promotion(spark):
    frame = lambda side: spark.createDataFrame([m for run in RUNS for m in run[side]], MAPPING)
    said = R.suggestions(frame(0))
    runs = spark.createDataFrame([(k + 1, 0) for k in range(len(RUNS))], "run_id long, warnings int")
    asked = runs.select("run_id").unionByName(spark.createDataFrame([(99,), (None,)], "run_id long"))
    mappings = R.canonical(said, frame(1))
    told = R.promotion(asked, runs, said, mappings, spark.createDataFrame([(8,)], "run_id long"))
    got = {r.run_id: (r.promoted, r.reason) for r in told.collect()}
    assert got == {k + 1: run[2:] for k, run in enumerate(RUNS)} | {99: (False, "generation_not_found"), None: (False, "missing_generation_id")}
    entries, items = R.learned(told, mappings)
    assert [r.run_id for r in entries.collect()] == [4] and [(r.run_id, r.status) for r in items.collect()] == [(4, "approved")]


def test_quality_and_what_is_left(spark):
    rows = [mapping(1, 0), mapping(1, 1, "c d", "y", "medium")]
    runs = spark.createDataFrame([(1, 1)], "run_id long, warnings int")
    promoted = R.promotion(runs.select("run_id"), runs, R.suggestions(spark.createDataFrame([], MAPPING)), spark.createDataFrame(rows, MAPPING), runs.select("run_id").limit(0))
    assert promoted.first().quality == 0.77
    entries, items = R.learned(promoted, spark.createDataFrame(rows, MAPPING))
    assert {(r.source, r.target) for r in entries.collect()} == {("a b", "x"), ("c d", "y")} and [(r.status, r.split) for r in items.collect()] == [("candidate", "validation")]


def test_versions_follow_changes_only(spark):
    rows = spark.createDataFrame([mapping(1, 0), mapping(2, 0), mapping(2, 1, band="low")], MAPPING)
    state = {r.run_id: r.state for r in R.state_hash(rows).collect()}
    versions = spark.createDataFrame([(1, 3, state[1]), (1, 2, "old"), (2, 5, "other"), (3, 1, "s")], "run_id long, version int, state string")
    got = {r.run_id: (r.version, r.parent, r.updated) for r in R.refreshed(versions, rows).collect()}
    assert got == {1: (3, None, False), 2: (6, 5, True), 3: (1, None, False)}
    patches = spark.createDataFrame([(1, 0, " a ", "x"), (1, 1, "a", "y"), (1, 2, " ", "z"), (2, 0, "", "z"), (9, 0, "b", "z")], "run_id long, pos long, field string, value string")
    fixes, after = R.patched(versions, patches)
    assert [tuple(r) for r in fixes.collect()] == [(1, "value_fix", "a", "y", True)] and [tuple(r) for r in after.collect()] == [(1, 4, 3)]


def test_states_of_a_stream_equal_those_of_the_replay(spark, tmp_path):
    """The log arrives file by file; the states of runs after the last one are those of the whole log."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    stream = LE.review_state(SL.suggestions(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)))
    query = stream.writeStream.format("memory").queryName("run_states").outputMode("complete").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = sorted(stream.columns)
    rows = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert rows(spark.table("run_states")) == rows(LE.review_state(SL.suggestions(events)))
