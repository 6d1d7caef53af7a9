import numpy as np
import pytest

from gridlight.plans import core_queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core_queries.ORACLES))
def test_matches_oracle(spark, con, name):
    compare(spark, con, SF, core_queries.QUERIES[name], core_queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.ORACLES)))
def test_runs(spark, name):
    assert core_queries.QUERIES[name](spark, SF).count() > 0


def test_covariance_of_all_components(spark, con):
    v = np.array([r[0] for r in con.sql("SELECT embedding FROM embeddings").fetchall()], np.float64)
    want = np.cov(v, rowvar=False)
    got = {(r.i, r.j): r.cov for r in core_queries.QUERIES["covariance_all"](spark, SF).collect()}
    assert v.shape[1] == 64 and set(got) == {(i, j) for i in range(64) for j in range(i, 64)}
    assert all(abs(c - want[k]) < 1e-6 for k, c in got.items())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
