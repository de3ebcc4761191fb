import os

import pytest

from sparkloom.plans import queries
from tests.oracle import connect, differences

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, con, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_joins_cover_whole_tables(spark, con):
    orders, customers = (con.execute(f"SELECT count(*) FROM {x}").fetchone()[0] for x in ("orders", "customer"))
    left, right, full = (queries.QUERIES[f"join_{x}"](spark, SF).collect() for x in ("left", "right", "full"))
    assert len(left) == orders and any(x.c_mktsegment is None for x in left)
    alone = sum(x.o_orderkey is None for x in right)
    assert 0 < alone < customers and len(full) == orders + alone


def test_bins_of_prices_half_between_digits(spark, tmp_path):
    prices = [500.0 * k + x for k in range(3, 900) for x in (405.0, 495.0, 499.99)]
    spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert differences(queries.QUERIES["bins_decimals"](spark, str(tmp_path)), connect(tmp_path), queries.SQL["bins_decimals"]) == []
