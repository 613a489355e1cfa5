import pytest
from pyspark.sql import functions as F

from fieldweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["w9_row_bands", "l1_word_lines"])
def test_pages_stay_small_and_every_event_is_on_one(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    got = QUERIES[name](spark, SF)
    pages = got.groupBy("page").count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert pages[0] == events and pages[1] <= 40 and pages[2] > 20
