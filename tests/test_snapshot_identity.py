from fieldweave.operators import evaluation as EV


def test_snapshots_of_other_items_differ(spark):
    def snapshot(ids):
        return EV.snapshot(spark.createDataFrame([(i, 0.9, "approved", "train") for i in ids], "id long, quality_score double, status string, split string"), 0.75, ["approved"]).first()

    a, b, c = snapshot([1, 2, 5, 9]), snapshot([1, 3, 5, 9]), snapshot([9, 5, 2, 1])
    assert (a.items, a.first_id, a.last_id) == (b.items, b.first_id, b.last_id)
    assert a.identity != b.identity and a.identity == c.identity
