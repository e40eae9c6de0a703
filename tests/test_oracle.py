"""Every registered query against its DuckDB oracle (sf0.001 here; the
driver repeats this at sf0.01)."""

from __future__ import annotations

import pytest

from fleetlens.plans.check import compare, duck_connect
from fleetlens.plans.registry import registry

SF = "/root/testdata/sf0.001"
REG = registry()


@pytest.fixture(scope="module")
def duck():
    con = duck_connect(SF)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    missing = [k for k, q in REG.items() if q.oracle is None]
    assert missing == []


@pytest.mark.parametrize("key", sorted(REG))
def test_query_matches_oracle(spark, duck, key):
    q = REG[key]
    res = compare(spark, duck, key, q.build, q.oracle, SF)
    assert res["status"] == "ok", res
    assert "type_mismatch" not in res, res


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(REG) <= set(e.oracle_sql())
