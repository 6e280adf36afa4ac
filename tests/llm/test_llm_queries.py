import os

import pytest
from compare import SMALL, assert_same, engine

from millrace.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return engine(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    out = QUERIES[name](spark, SMALL)
    assert out.count() > 0 or name == "p8_found"
    if name == "p7_fill":
        assert all(0 <= r.unused < r.plain_unused < 1 and r.fullest <= r.capacity for r in out.collect())
    if name == "p6_roundtrip":
        assert out.agg({"differing": "sum"}).first()[0] == 0


def test_no_limits_give_no_container(spark, tmp_path):
    spark.createDataFrame([(None, "byte_bpe_50k", 5), (1, None, 5), (2, "byte_bpe_50k", None)], "limit_id bigint, tokenizer string, capacity int").write.parquet(str(tmp_path / "pack_limits.parquet"))
    spark.createDataFrame([(1, "a b")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["p7_pack"](spark, str(tmp_path)).count() == 0


def test_packing_of_the_table(spark):
    """Each text that has tokens lies in containers once for each limit, none of which is overfull, and little room is left."""
    packed = QUERIES["p7_pack"](spark, SMALL).toPandas()
    for limit, own in packed.groupby("limit_id"):
        room = {1: 512, 2: 2048, 3: 8192}[limit]
        load = own.groupby("container").tokens.sum()
        assert load.max() <= room
        for _, pieces in own.sort_values("first").groupby("doc_id"):
            assert (pieces["first"].to_numpy() == pieces.tokens.cumsum().shift(fill_value=0).to_numpy()).all()
            assert len(pieces) == 1 or pieces.tokens.sum() > room
        assert len(load) <= load.sum() / room * 1.05 + 1
