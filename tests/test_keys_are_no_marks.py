"""Forms whose values are keys: an order with key 0 or 1 is a label with a value like any other, not a mark beside an option."""

import duckdb
import pytest

from fieldweave.plans.oracle import ORACLE_SQL
from fieldweave.plans.queries import QUERIES

from test_core_queries import rows, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small tables, with the orders 0 and 1 made urgent and cheap."""
    made = tmp_path_factory.mktemp("keys")
    urgent = "CASE WHEN o_orderkey < 2 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey < 2 THEN 100000.0 ELSE o_totalprice END AS o_totalprice"
    duckdb.sql(f"COPY (SELECT * REPLACE ({urgent}) FROM '{SF}/orders.parquet') TO '{made}/orders.parquet' (FORMAT parquet)")
    (made / "customer.parquet").symlink_to(f"{SF}/customer.parquet")
    return made


@pytest.mark.parametrize("name", ["a19_form_quality", "l12_form_scalars", "l9_table_groups", "l9_table_scalars"])
def test_orders_0_and_1_are_values(spark, folder, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    got, want = rows(got), rows(want)
    assert len(got) == len(want) and not [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]
