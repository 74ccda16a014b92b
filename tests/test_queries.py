"""Registered queries against their oracles on the smallest tables."""

import pytest

from __spark_entry__ import entry
from basketflow.plans.registered import QUERIES
from compare import difference, duck
from oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert difference(QUERIES[key](spark, SF), con, ORACLES[key]) is None


def test_entry_has_rows(spark):
    rows = entry(spark).collect()
    assert rows
    for r in rows:
        assert r.ts_ns - r.initial_ts_ns == 45 * 10**9
        assert abs(r.matched_vol / r.quantity - r.num_lot) <= 5e-5
        assert 0 <= r.initial_ts_ns - r.block_start_ns < 10**9
    keys = [(r.run_date, r.time_str, r.stock, r.initial_ts_ns, r.ts_ns) for r in rows]
    assert len(keys) == len(set(keys))
