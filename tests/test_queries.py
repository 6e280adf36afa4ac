import os

import pytest
from compare import SMALL, assert_same, engine

from millrace.queries import catalogue, core_modules
from millrace.queries.inputs import EVENTS

QUERIES, SQL = catalogue(core_modules())

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return engine(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - {"lbfgs_train", "sgd_train", "bcd_train"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_invariants(spark):
    sizes = {r.batch_id: (r.rows, r.from_buffer, r.to_buffer) for r in QUERIES["shuffle_buffer"](spark, SMALL).collect()}
    assert all(a == b == batch // 5 for batch, (_, a, b) in sizes.items())
    ids = {r.key for r in QUERIES["kv_union_plus"](spark, SMALL).collect()}
    assert {r.matched for r in QUERIES["kv_match_plus"](spark, SMALL).collect()} == {True, False} and len(ids) > 0
    assert all(r.differs == 0 for r in QUERIES["model_roundtrip"](spark, SMALL).collect())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_group_takes_its_steps(spark, con):
    steps = {r.fid: r for r in QUERIES["bcd_group_steps"](spark, SMALL).collect()}
    assert steps.keys() == {r.fid for r in QUERIES["feature_counts"](spark, SMALL).collect()}
    assert {r.grp for r in steps.values()} == {0, 1, 2, 3, 4} and all(r.grp == f & 4095 for f, r in steps.items())
    touched = con.execute(f"WITH {EVENTS} SELECT count(*) FROM (SELECT DISTINCT row_id, fid & 4095 FROM ev)").fetchone()[0]
    assert QUERIES["bcd_group_margins"](spark, SMALL).count() == touched
