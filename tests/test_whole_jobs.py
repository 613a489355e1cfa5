"""Queries that once did less than their whole job: every row of the tables counts."""

import pandas as pd

from fieldweave.operators import evaluation as EV
from fieldweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_every_order_and_customer_is_a_run_and_every_line_a_version(spark):
    orders, line = read("orders"), read("lineitem")
    got = QUERIES["j13_run_context"](spark, SF).toPandas().set_index("run_id")
    assert set(got.index) == set(orders.o_orderkey) | set(-read("customer").c_custkey - 1) and got.index.is_unique
    newest = line.groupby("l_orderkey").l_linenumber.max().reindex(orders.o_orderkey, fill_value=-1)
    assert (newest == -1).any() and (got.version.loc[newest.index] == newest).all()
    last = line[line.l_linenumber == line.l_orderkey.map(newest)].groupby("l_orderkey").agg(state=("l_returnflag", "min"), price=("l_extendedprice", "max"))
    assert (got.loc[last.index, ["state", "price"]] == last).all(axis=None)
    bought = orders.groupby(-orders.o_custkey - 1).o_orderkey.max()
    assert (got.version.loc[bought.index] == bought).all()
    assert (got.loc[newest.index[newest == -1], ["state", "price"]] == ["none", -1.0]).all(axis=None)


def test_every_target_of_every_order_is_mapped_or_said_to_be_open(spark):
    orders, line = read("orders"), read("lineitem")
    urgent = set(orders.o_orderkey[orders.o_orderpriority == "1-URGENT"])
    got = QUERIES["m5_by_position"](spark, SF).toPandas()
    assert len(got) == len(line) + len(urgent) and set(got.case_id) == set(line.l_orderkey) | urgent
    found = {case: sorted(zip(r.target, r.source, r.band, r.reason, strict=True)) for case, r in got.groupby("case_id")}
    for case, rows in line.groupby("l_orderkey"):
        targets = [(f"t{n}", f"c{p}", flag == "R") for n, p, flag in zip(rows.l_linenumber, rows.l_partkey, rows.l_returnflag, strict=True)]
        if case in urgent or any(back for _, _, back in targets):
            want = [(t, s, "high", "returned") if back else (t, "none", "none", "not_found") for t, s, back in targets]
            want += [("more", "none", "none", "not_found")] if case in urgent else []
        else:
            pos = sorted(zip(rows.l_linenumber, [s for _, s, _ in targets], strict=True))
            want = [(f"t{n}", s, "low", "position_fallback") for n, s in pos]
        assert found[case] == sorted(want)
    assert any(r == [("more", "none", "none", "not_found")] for r in found.values())


def test_cases_that_lack_a_run_have_deltas(spark):
    schema = "case_id long, exact double, false_positive double, unresolved double"
    off, on = spark.createDataFrame([(1, 0.5, 0.25, 0.25), (2, 1.0, 0.0, 0.0)], schema), spark.createDataFrame([(1, 0.75, 0.0, 0.25), (3, 0.5, 0.5, 0.0)], schema)
    got = EV.graph_deltas(off, on, spark.createDataFrame([(1,), (4,)], "case_id long")).collect()
    assert sorted(map(tuple, got)) == [(1, 0.25, -0.25, 0.0), (2, -1.0, 0.0, 0.0), (3, 0.5, 0.5, 0.0), (4, 0.0, 0.0, 0.0)]


def test_every_supplier_and_order_is_a_case(spark):
    orders, line = read("orders"), read("lineitem")
    got = QUERIES["j20_case_deltas"](spark, SF).toPandas().set_index("case_id")
    assert set(got.index) == set(read("supplier").s_suppkey) | set(-orders.o_orderkey - 1) and got.index.is_unique
    runs = line.assign(exact=line.l_returnflag == "A").groupby([-line.l_orderkey - 1, line.l_linestatus == "O"]).exact.mean().unstack()
    want = (runs[True].fillna(0.0) - runs[False].fillna(0.0)).reindex(-orders.o_orderkey - 1, fill_value=0.0)
    assert runs[True].isna().any() and runs[False].isna().any() and len(runs) < len(orders)
    assert (got.exact_delta.loc[want.index] - want).abs().max() <= 0.00005001
