"""Nulls in any column, repeated rows, empty tables and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import features as X
from millrace.operators import linalg, losses, metrics, updates
from millrace.params import BCDLearn, BCDUpdate, LBFGSLearn, LBFGSUpdate, SGDLearn, SGDUpdate
from millrace.plans.bcd import train_bcd
from millrace.plans.lbfgs import train_lbfgs
from millrace.plans.model import predict
from millrace.plans.sgd import train_sgd

#: Columns that operators use names of for themselves.
CLASH = "w double, v string, g int, x string, y string, margin double, cnt string, pos int, blk string, key string, value string, _x int, _w int, _m int, _part int, batch_id string"
ENTRIES = "row_id bigint, label double, fid bigint, val double"
ROWS = "row_id bigint, label double, features array<struct<idx: bigint, val: double>>"


def clashing(df):
    for c in CLASH.split(", "):
        name, kind = c.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def entries(spark):
    data = [(1, 1.0, 5, 2.0), (1, 1.0, 5, 2.0), (1, 1.0, None, 1.0), (2, 0.0, 5, None), (2, 0.0, 6, 3.0), (None, 1.0, 5, 1.0), (3, None, 6, 1.0)]
    return clashing(spark.createDataFrame(data, ENTRIES))


@pytest.fixture(scope="module")
def rows(spark):
    return clashing(spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None), (4, 1.0)], "row_id bigint, label double"))


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([(5, 0.5, [1.0, 2.0]), (6, -1.0, None), (None, 9.0, [9.0, 9.0])], "fid bigint, w double, v array<double>").withColumn("row_id", F.lit(1)).withColumn("val", F.lit(2))


def got(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_products(entries, model):
    x = model.select("fid", F.col("w").alias("x"), "val", "row_id")
    out = got(linalg.times(entries, x), "row_id", "y")
    assert out == {1: 2.0, 2: -3.0, 3: -1.0, None: 0.5}
    k = got(linalg.times_columns(entries, model.select("fid", F.col("v").alias("x")), 2), "row_id", "y")
    assert k[1] == [4.0, 8.0] and k[2] == [0.0, 0.0]
    sizes = linalg.transpose(entries, span=2).groupBy("fid").agg(F.sum(F.size("items")).alias("n"), F.count(F.lit(1)).alias("pieces"))
    assert {r.fid: r.n for r in sizes.collect()} == {5: 4, 6: 2, None: 1}
    assert max(r.pieces for r in sizes.collect()) > 1


def test_losses(entries, rows, model):
    scored = losses.margins(entries, rows, model)
    assert got(scored, "row_id", "margin") == {1: 2.0, 2: -3.0, 3: -1.0, 4: 0.0}
    g = got(losses.gradient(entries, scored), "fid", "g")
    assert g.keys() >= {5, 6} and np.isclose(g[5], 4.0 * -1 / (1 + np.exp(2))) and np.isclose(g[6], 3.0 / (1 + np.exp(3)))
    assert losses.margins(entries, rows.limit(0), model).count() == 0
    assert got(losses.margins(entries, rows, model.limit(0), 2), "row_id", "margin") == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert losses.gradient(entries.limit(0), scored).count() == 0


def test_measures(spark):
    df = clashing(spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (0.0, 1.0), (None, 5.0), (1.0, None), (1.0, 0.5)], "label double, margin double"))
    a = metrics.auc(df).first()
    assert a.rows == 4 and a.auc == 0.5
    assert metrics.accuracy(df, 0.6).first()[:2] == (4, 1)
    assert metrics.auc(df.limit(0)).first().rows == 0 and metrics.auc(df.limit(0), ["blk"]).count() == 0
    assert metrics.merged(metrics.progress(df.limit(0), ["blk"])).first().auc is None


def test_features(entries):
    assert got(X.feature_counts(entries), "fid", "cnt") == {5: 4, 6: 2}
    assert X.dictionary(entries.limit(0)).count() == 0
    words = X.dictionary(entries)
    assert X.localize(entries, words).count() == 6
    assert X.column_map(entries.withColumn("blk", F.lit("b")), words).filter("fid is null and pos = -1").count() == 1
    assert X.in_order(entries, 2).groupBy("batch_id").count().count() == 4 and X.in_order(entries.limit(0), 2).count() == 0
    assert X.keep_negatives(entries, 0.0).count() == 4
    assert X.group_stats(entries.limit(0), entries, 4).count() == 0


def test_updates(spark, model):
    p = SGDUpdate(l1=0.1, lr=0.5, V_dim=2, V_threshold=0)
    init = updates.random_vector(0)
    counts = spark.createDataFrame([(5, 3), (7, 1)], "fid bigint, cnt bigint")
    m = updates.add_counts(updates.new_model(counts.limit(0), 2), counts, p, init)
    assert got(m, "fid", "cnt") == {5: 3.0, 7: 1.0}
    grad = spark.createDataFrame([(5, 1.0, None), (99, 1.0, None)], "fid bigint, g double, gv array<double>")
    out = updates.apply_gradient(m, grad, p, init)
    assert got(out, "fid", "w")[7] == 0 and got(out, "fid", "w")[5] != 0 and got(out, "fid", "v")[5] is not None
    assert updates.apply_gradient(m.limit(0), grad, p, init).count() == 0


TRAINERS = [
    (train_sgd, SGDLearn(max_num_epochs=1), SGDUpdate(l1=0.01, lr=0.5)),
    (train_sgd, SGDLearn(max_num_epochs=1, batch_size=3), SGDUpdate(l1=0.01, lr=0.5)),
    (train_lbfgs, LBFGSLearn(max_num_epochs=1), LBFGSUpdate(tail_feature_filter=0)),
    (train_bcd, BCDLearn(max_num_epochs=1), BCDUpdate(l1=0.01, tail_feature_filter=0)),
]


@pytest.mark.parametrize("case", range(len(TRAINERS)))
def test_solvers(spark, case):
    train, learn, update = TRAINERS[case]
    data = [(1, 1.0, [(5, 1.0), (5, 1.0), (None, 1.0)]), (1, 1.0, [(5, 1.0)]), (2, 0.0, None), (3, 0.0, []), (4, None, [(6, 1.0)]), (5, 0.0, [(7, None)])]
    rows = clashing(spark.createDataFrame(data, ROWS))
    out = train(rows, learn, update)
    assert len(out.history) == 1 and {r.fid for r in out.model.collect()} <= {5, 6, 7}
    assert predict(rows, out).count() == 6
    none = train(rows.limit(0), learn, update)
    assert none.model.count() == 0
