"""What a memory sums up is summed in the order of the log, however its rows are dealt: many scores are equal but for the rounding of sums."""

import duckdb
import pytest

from fieldweave.operators import feedback as FB
from fieldweave.plans.oracle import ORACLE_SQL
from fieldweave.plans.queries import QUERIES

from test_core_queries import rows, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events of few users with few values, in order and in several row groups, each read by a task of its own."""
    made = tmp_path_factory.mktemp("log")
    few = "user_id % 40 AS user_id, CAST(round(value / 10) * 10 AS DOUBLE) AS value"
    duckdb.sql(f"COPY (SELECT * REPLACE ({few}) FROM '{SF}/events.parquet' ORDER BY event_id) TO '{made}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    return made


@pytest.mark.parametrize("name", ["m15_personal_candidates", "m18_draft_names", "t3_remembered"])
def test_equal_scores_rank_as_in_sql(spark, folder, name):
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = QUERIES[name](spark, str(folder)).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got, want = rows(got), rows(con.sql(ORACLE_SQL[name]).df())
    assert len(got) == len(want) and not [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]


def test_sums_follow_event_ids(spark):
    given = [(k, 1, "a", "b", True, c) for k, c in enumerate((0.3, 0.1, 0.2, 0.7))]
    log = spark.createDataFrame(given[::-1], "event_id long, user_id long, source string, target string, accepted boolean, confidence double").selectExpr("*", "timestamp_seconds(0) as ts").coalesce(1)
    got = FB.memory(log).first()
    assert (got.mean_confidence, got.weight) == ((((0.3 + 0.1) + 0.2) + 0.7) / 4, ((0.3 + 0.2) + 0.2) + 0.7)
    none = FB.memory(log.selectExpr("event_id", "user_id", "source", "target", "false as accepted", "cast(null as double) as confidence", "ts")).first()
    assert (none.mean_confidence, none.weight, none.failure_count) == (None, 0.0, 4)
