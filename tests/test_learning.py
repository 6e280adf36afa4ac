import os

import numpy as np
import pytest
from brute import dense, fixed_rows, fm, loss, sample, slopes
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import features as X
from millrace.operators import linalg, losses, metrics
from millrace.params import BCDLearn, BCDUpdate, LBFGSLearn, LBFGSUpdate, SGDLearn, SGDUpdate
from millrace.plans.bcd import train_bcd
from millrace.plans.lbfgs import train_lbfgs, two_loop
from millrace.plans.model import load_model, predict, save_model
from millrace.plans.sgd import train_sgd
from millrace.sources.readers import read

ROWS = "row_id bigint, label double, features array<struct<idx: bigint, val: double>>"
K = 3


def setup(spark, seed=0, **kw):
    data = sample(seed, **kw)
    df = spark.createDataFrame(data, ROWS)
    x, y, ids = dense(data)
    r = np.random.default_rng(seed + 1)
    w, v = np.round(r.normal(size=len(ids)), 3), np.round(r.normal(size=(len(ids), K)) / 2, 3)
    model = spark.createDataFrame([(k, float(a), [float(z) for z in b]) for k, a, b in zip(ids, w, v)], "fid bigint, w double, v array<double>")
    return df, x, y, ids, w, v, model


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_products(spark):
    df, x, _, ids, w, v, model = setup(spark)
    e = X.triples(df)
    got = column(linalg.times(e, model.select("fid", F.col("w").alias("x"))), "row_id", "y")
    assert np.allclose([got[i] for i in range(len(x))], x @ w)
    u = np.arange(len(x)) - 5.0
    side = spark.createDataFrame([(i, float(a)) for i, a in enumerate(u)], "row_id bigint, x double")
    got = column(linalg.times(e, side, "row_id", "fid"), "fid", "y")
    assert np.allclose([got.get(k, 0) for k in ids], x.T @ u)
    got = column(linalg.times_columns(e, model.select("fid", F.col("v").alias("x")), K), "row_id", "y")
    assert np.allclose([got[i] for i in range(len(x))], x @ v)
    got = column(linalg.times_columns(e, model.select("fid", F.col("v").alias("x")), K, square=True), "row_id", "y")
    assert np.allclose([got[i] for i in range(len(x))], (x * x) @ (v * v))
    back = linalg.untranspose(linalg.transpose(e))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.select("row_id", "fid", "val").collect()))
    assert linalg.times(e.limit(0), model.select("fid", F.col("w").alias("x"))).count() == 0


def test_zero_weights_never_meet_infinite_values(spark):
    e = spark.createDataFrame([(1, 5, float("inf")), (1, 6, 2.0)], "row_id bigint, fid bigint, val double")
    m = spark.createDataFrame([(5, 0.0), (6, 3.0)], "fid bigint, x double")
    assert linalg.times(e, m).first().y == 6.0


def test_linear_loss_and_gradient(spark):
    df, x, y, ids, w, _, model = setup(spark)
    e = X.triples(df)
    scored = losses.margins(e, df, model)
    assert np.isclose(scored.agg(metrics.objective().alias("f")).first().f, loss(y, x @ w))
    got = column(losses.gradient(e, scored), "fid", "g")
    assert np.allclose([got[k] for k in ids], slopes(lambda a: loss(y, x @ a), w), atol=1e-5)
    both = losses.gradient_and_curvature(e, scored)
    h = column(both, "fid", "h")
    s = 1 / (1 + np.exp(-(x @ w)))
    assert np.allclose([h[k] for k in ids], (x * x).T @ (s * (1 - s)))


def test_factorization_machine_equals_all_pairs(spark):
    df, x, y, ids, w, v, model = setup(spark, rows=25, ids=12)
    e = X.triples(df)
    scored = losses.margins(e, df, model, K)
    m = column(scored, "row_id", "margin")
    assert np.allclose([m[i] for i in range(len(x))], fm(x, w, v))
    g = {r.fid: r for r in losses.gradient(e, scored, model, K).collect()}
    assert np.allclose([g[k].g for k in ids], slopes(lambda a: loss(y, fm(x, a, v)), w), atol=1e-5)
    assert np.allclose([g[k].gv for k in ids], slopes(lambda a: loss(y, fm(x, w, a)), v), atol=1e-5)


def test_missing_embeddings_are_linear_and_rows_without_features_score_zero(spark):
    df, x, y, ids, w, v, model = setup(spark, rows=20, ids=10)
    some = model.withColumn("v", F.when(F.pmod("fid", F.lit(2)) == 0, F.col("v")))
    v0 = np.where((np.array(ids) % 2 == 0)[:, None], v, 0)
    more = df.union(spark.createDataFrame([(99, 1.0, None), (100, 0.0, [(12345, 2.0)])], ROWS))
    e = X.triples(more)
    scored = losses.margins(e, more, some, K)
    m = column(scored, "row_id", "margin")
    assert m[99] == m[100] == 0 and np.allclose([m[i] for i in range(len(x))], fm(x, w, v0))
    g = {r.fid: r.gv for r in losses.gradient(e, scored, some, K).collect()}
    assert all((g[k] is None) == (k % 2 == 1) for k in ids)


def test_margins_are_clamped_with_embeddings_only(spark):
    e = spark.createDataFrame([(1, 5, 100.0)], "row_id bigint, fid bigint, val double")
    rows = spark.createDataFrame([(1, 1.0)], "row_id bigint, label double")
    m = spark.createDataFrame([(5, 1.0, [0.0])], "fid bigint, w double, v array<double>")
    assert losses.margins(e, rows, m).first().margin == 100.0
    assert losses.margins(e, rows, m, 1).first().margin == 20.0
    assert losses.margins(e, rows, m, 1, clamped=False).first().margin == 100.0


def test_measures(spark):
    r = np.random.default_rng(0)
    for n, kinds in [(200, 2), (50, 2), (20, 1)]:
        m, y = np.round(r.normal(size=n), 1), (r.integers(0, kinds, n)).astype(float)
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, m))], "row_id bigint, label double, margin double")
        p, q = m[y > 0], m[y <= 0]
        out = metrics.auc(df).first()
        if len(p) and len(q):
            want = (np.sum(p[:, None] > q) + 0.5 * np.sum(p[:, None] == q)) / len(p) / len(q)
            assert np.isclose(out.auc, want) and np.isclose(out.auc_sum, n * max(want, 1 - want))
        else:
            assert out.auc is None and out.auc_sum == 1.0
        a = metrics.accuracy(df, 0.3).first()
        good = int(np.sum((y > 0) == (m > 0.3)))
        assert (a.rows, a.correct, a.acc_sum) == (n, good, max(good, n - good))
    empty = df.limit(0)
    assert empty.agg(metrics.objective().alias("x")).first().x == 0 and metrics.accuracy(empty).first().rows == 0
    one = spark.createDataFrame([(0.0, 800.0)], "label double, margin double")
    assert one.agg(metrics.log_loss().alias("x")).first().x == float("inf")
    assert one.agg(metrics.objective().alias("x")).first().x == 800.0


def test_two_loop_example():
    vectors = {"s": np.array([2.0, 3]), "y": np.array([3.0, 4]), "g": np.array([1.0, 2])}
    gram = {frozenset((a, b)): float(vectors[a] @ vectors[b]) for a in vectors for b in vectors}
    weights = two_loop(gram, ["s"], ["y"])
    assert np.allclose(sum(w * vectors[n] for n, w in weights.items()), [(54 - 202) / 225, (-36 - 303) / 225])


def test_two_loop_equals_the_textbook():
    r = np.random.default_rng(1)
    m, n = 4, 9
    s, y, g = r.normal(size=(m, n)), r.normal(size=(m, n)), r.normal(size=n)
    vectors = {f"s{i}": s[i] for i in range(m)} | {f"y{i}": y[i] for i in range(m)} | {"g": g}
    gram = {frozenset((a, b)): float(vectors[a] @ vectors[b]) for a in vectors for b in vectors}
    q, alpha = -g, [0.0] * m
    for i in reversed(range(m)):
        alpha[i] = s[i] @ q / (s[i] @ y[i])
        q = q - alpha[i] * y[i]
    q = q * (s[-1] @ y[-1]) / (y[-1] @ y[-1])
    for i in range(m):
        q = q + s[i] * (alpha[i] - y[i] @ q / (s[i] @ y[i]))
    got = two_loop(gram, [f"s{i}" for i in range(m)], [f"y{i}" for i in range(m)])
    assert np.allclose(sum(w * vectors[k] for k, w in got.items()), q, atol=1e-6)


def ftrl_by_hand(x, y, p, epochs):
    w = s = z = np.zeros(x.shape[1])
    out = []
    for _ in range(epochs):
        m = x @ w
        out.append(loss(y, m))
        g = x.T @ (-y / (1 + np.exp(y * m))) + p.l2 * w
        t = np.sqrt(s * s + g * g)
        z = z - (g - (t - s) / p.lr * w)
        s = t
        w = np.where(np.abs(z) <= p.l1, 0, (z - np.sign(z) * p.l1) * p.lr / (p.lr_beta + s))
    return out, w


def test_sgd_equals_a_plain_version(spark):
    df, x, y, ids, *_ = setup(spark)
    p = SGDUpdate(l1=0.05, l2=0.1, lr=0.5)
    out = train_sgd(df, SGDLearn(batch_size=0, max_num_epochs=4, stop_rel_objv=-1), p)
    want, w = ftrl_by_hand(x, y, p, 4)
    assert np.allclose([h["loss"] for h in out.history], want)
    got = column(out.model, "fid", "w")
    assert np.allclose([got[k] for k in ids], w)


def test_sgd_with_embeddings_equals_a_plain_version(spark):
    df, x, y, ids, *_ = setup(spark, rows=15, ids=8)
    p = SGDUpdate(l1=0.01, lr=0.5, V_dim=2, V_threshold=2, V_lr=0.3, V_init_scale=0.2)
    init = lambda fid, dim, scale: F.array(*((F.pmod(F.col(fid), F.lit(7)) - 3 + j) * scale for j in range(dim)))
    start = np.array([[(k % 7 - 3 + j) * 0.2 for j in range(2)] for k in ids])
    n = len(ids)
    cnt, w, s, z, v, c, has = (x != 0).sum(0), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(n, bool)
    want = []
    for _ in range(4):
        m = np.clip(fm(x, w, np.where(has[:, None], v, 0)), -20, 20)
        want.append(loss(y, m))
        q = -y / (1 + np.exp(y * m))
        live = np.where(has[:, None], v, 0)
        gv = x.T @ (q[:, None] * (x @ live)) - ((x * x).T @ q)[:, None] * live + p.V_l2 * live
        g = x.T @ q
        t = np.sqrt(s * s + g * g)
        z = z - (g - (t - s) / p.lr * w)
        s, was = t, w
        w = np.where(np.abs(z) <= p.l1, 0, (z - np.sign(z) * p.l1) * p.lr / (p.lr_beta + s))
        t = np.sqrt(c * c + gv * gv)
        v, c = np.where(has[:, None], v - p.V_lr / (t + p.V_lr_beta) * gv, v), np.where(has[:, None], t, c)
        new = ~has & (cnt > p.V_threshold) & (was == 0) & (w != 0)
        v, has = np.where(new[:, None], start, v), has | new
    out = train_sgd(df, SGDLearn(batch_size=0, max_num_epochs=4, stop_rel_objv=-1), p, init=init)
    assert np.allclose([h["loss"] for h in out.history], want)
    got = {r.fid: r.v for r in out.model.collect()}
    assert all((got[k] is not None) == has[i] and (not has[i] or np.allclose(got[k], v[i])) for i, k in enumerate(ids))


def test_sgd_batches_validation_and_stop(spark):
    df, *_ = setup(spark)
    seen = []
    out = train_sgd(df, SGDLearn(batch_size=15, max_num_epochs=2, shuffle=2, stop_rel_objv=-1, stop_val_auc=-9), SGDUpdate(l1=0.01, lr=0.5), val=df, on_epoch=lambda k, r: seen.append(k))
    assert seen == [0, 1] and out.history[0]["rows"] == 40 and "val_auc" in out.history[0]
    out = train_sgd(df, SGDLearn(max_num_epochs=5), SGDUpdate(l1=100.0))
    assert len(out.history) == 2


def ftrl_by_batches(x, y, p, epochs, parts):
    """parts: per part its batches, lists of row numbers. All parts of an epoch start from the same state; what they add is put together."""
    n = x.shape[1]
    w = s = z = np.zeros(n)
    losses = []
    for _ in range(epochs):
        total, ends = 0.0, []
        for batches in parts:
            own_w, own_s, own_z = w.copy(), s.copy(), z.copy()
            for b in batches:
                m = x[b] @ own_w
                total += loss(y[b], m)
                met = (x[b] != 0).any(0)
                g = x[b].T @ (-y[b] / (1 + np.exp(y[b] * m))) + p.l2 * own_w
                t = np.sqrt(own_s**2 + g * g)
                pull = own_z - (g - (t - own_s) / p.lr * own_w)
                new = np.where(np.abs(pull) <= p.l1, 0, (pull - np.sign(pull) * p.l1) * p.lr / (p.lr_beta + t))
                own_w, own_s, own_z = np.where(met, new, own_w), np.where(met, t, own_s), np.where(met, pull, own_z)
            ends.append((own_s, own_z))
        z = z + sum(e[1] - z for e in ends)
        s = np.sqrt(s**2 + sum(e[0] ** 2 - s**2 for e in ends))
        w = np.where(np.abs(z) <= p.l1, 0, (z - np.sign(z) * p.l1) * p.lr / (p.lr_beta + s))
        losses.append(total)
    return losses, w


@pytest.mark.parametrize("jobs", [1, 3])
def test_minibatches_equal_a_plain_version(spark, jobs):
    df, x, y, ids, *_ = setup(spark)
    p = SGDUpdate(l1=0.02, l2=0.05, lr=0.4)
    n, size = len(x), 6
    parts = [np.arange(-(-k * n // jobs), -(-(k + 1) * n // jobs)) for k in range(jobs)]
    want, w = ftrl_by_batches(x, y, p, 3, [[b[i : i + size] for i in range(0, len(b), size)] for b in parts])
    out = train_sgd(df, SGDLearn(batch_size=size, num_jobs_per_epoch=jobs, shuffle=0, max_num_epochs=3, stop_rel_objv=-1), p)
    assert np.allclose([h["loss"] for h in out.history], want)
    got = column(out.model, "fid", "w")
    assert np.allclose([got[k] for k in ids], w)
    assert column(out.model, "fid", "cnt") == {k: float(c) for k, c in zip(ids, (x != 0).sum(0))}


@pytest.mark.parametrize("loss_name", ["fm", "logit"])
def test_a_minibatch_of_all_rows_is_the_whole_batch(spark, loss_name):
    df, x, *_ = setup(spark, rows=30, ids=10)
    df = df.union(spark.createDataFrame([(90, 1.0, None), (91, None, [(5, 1.0)]), (92, 0.0, [(None, 1.0), (42, None), (42, 2.0)])], ROWS))
    p = SGDUpdate(l1=0.01, l2=0.02, lr=0.5, V_dim=2, V_threshold=2, V_lr=0.3, V_init_scale=0.2)
    one, two = (train_sgd(df, SGDLearn(batch_size=b, num_jobs_per_epoch=1, loss=loss_name, max_num_epochs=4, stop_rel_objv=-1), p) for b in (0, 1000))
    for a, b in zip(one.history, two.history):
        assert all(np.isclose(a[k], b[k]) for k in ("loss", "penalty", "auc_sum", "rows"))
    a, b = ({r.fid: r for r in m.model.collect()} for m in (one, two))
    assert a.keys() == b.keys() and any(r.v is not None for r in a.values()) == (loss_name == "fm")
    for k in a:
        assert np.isclose(a[k].w, b[k].w) and np.isclose(a[k].s, b[k].s) and (a[k].v is None) == (b[k].v is None) and (a[k].v is None or np.allclose(a[k].v, b[k].v) and np.allclose(a[k].c, b[k].c))


def test_training_goes_on_from_a_model_and_leaves_one_folder(spark, tmp_path):
    import os

    df, x, y, ids, *_ = setup(spark)
    p = SGDUpdate(l1=0.02, lr=0.4)
    learn = lambda n: SGDLearn(batch_size=7, num_jobs_per_epoch=2, shuffle=3, max_num_epochs=n, stop_rel_objv=-1)
    whole, first = train_sgd(df, learn(3), p), train_sgd(df, learn(2), p)
    folder = os.path.dirname(first.path).removeprefix("file:")
    before = set(os.listdir(folder))
    again = train_sgd(df, learn(1), p, model=first.model)
    a, b = column(whole.model, "fid", "w"), column(again.model, "fid", "w")
    assert all(np.isclose(a[k], b[k]) for k in ids)
    assert {f for f in set(os.listdir(folder)) - before if f.startswith("table-")} == {os.path.basename(again.path)}
    again.drop()
    assert os.path.basename(again.path) not in os.listdir(folder)


def test_no_rows_at_all(spark):
    none = spark.createDataFrame([], ROWS)
    for b in (0, 10):
        out = train_sgd(none, SGDLearn(batch_size=b, max_num_epochs=2), SGDUpdate())
        assert out.history[0]["rows"] == 0 and out.model.count() == 0
    assert train_bcd(none, BCDLearn(max_num_epochs=1)).model.count() == 0
    out = train_lbfgs(none, LBFGSLearn(max_num_epochs=1), LBFGSUpdate(V_dim=2))
    assert out.model.count() == 0 and out.history[0]["objv"] == 0


def lbfgs_by_hand(f, grad, theta, l, m, epochs, init_alpha):
    hist_s, hist_y, out, before = [], [], [], None
    obj, g = f(theta), grad(theta)
    alpha = 0.0
    for k in range(epochs):
        if k:
            hist_y.append(g - before)
            hist_s[-1] = hist_s[-1] * alpha
            hist_y = hist_y[-m:]
        q = -g
        if k:
            a = []
            for s, y in zip(hist_s[::-1], hist_y[::-1]):
                a.append(s @ q / (s @ y + 1e-10))
                q = q - a[-1] * y
            q = q * (hist_s[-1] @ hist_y[-1]) / (hist_y[-1] @ hist_y[-1] + 1e-10)
            for s, y, b in zip(hist_s, hist_y, a[::-1]):
                q = q + s * (b - y @ q / (s @ y + 1e-10))
        d = np.clip(q, -5, 5)
        hist_s = [*hist_s, d][-m:]
        before, slope = g, g @ d
        alpha = init_alpha if k == 0 else 1.0
        start = theta
        for trial in range(5):
            theta = start + alpha * d
            new, g = f(theta), grad(theta)
            if new <= obj + l.c1 * alpha * slope and g @ d >= l.c2 * slope or trial == 4:
                break
            alpha *= l.rho
        obj = new
        out.append(obj)
    return out


def test_lbfgs_equals_a_plain_version(spark):
    df, x, y, ids, *_ = setup(spark, rows=30, ids=10)
    learn, update = LBFGSLearn(max_num_epochs=4, init_alpha=0.3), LBFGSUpdate(m=2, l2=0.1, V_l2=0.05, V_dim=2, tail_feature_filter=0)
    init = lambda fid, dim, scale: F.array(*((F.pmod(F.col(fid), F.lit(5)) - 2 + j) * scale for j in range(dim)))
    n = len(ids)
    start = np.concatenate([np.zeros(n), np.array([[(k % 5 - 2 + j) * 0.01 for j in range(2)] for k in ids]).ravel()])
    f = lambda t: loss(y, np.clip(fm(x, t[:n], t[n:].reshape(n, 2)), -20, 20)) + 0.05 * t[:n] @ t[:n] + 0.025 * t[n:] @ t[n:]
    want = lbfgs_by_hand(f, lambda t: slopes(f, t), start, learn, 2, 4, 0.3)
    out = train_lbfgs(df, learn, update, val=df, init=init)
    assert np.allclose([h["objv"] for h in out.history], want, rtol=1e-4)
    assert out.history[-1]["nnz_w"] == 3 * n


def bcd_by_hand(x, y, p, blocks, epochs):
    w, delta, m, out = np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(len(x)), []
    for _ in range(epochs):
        for b in blocks:
            q = -y / (1 + np.exp(y * m))
            g, u = x[:, b].T @ q, (x[:, b] ** 2).T @ (-q * (y + q)) / p.lr + 1e-10
            d = np.where(g + p.l1 <= u * w[b], -(g + p.l1) / u, np.where(g - p.l1 >= u * w[b], -(g - p.l1) / u, -w[b]))
            d = np.clip(d, -delta[b], delta[b])
            delta[b] = np.minimum(5, 2 * np.abs(d) + 0.1)
            w[b] += d
            m = m + x[:, b] @ d
        out.append(loss(y, m))
    return out, w


def test_bcd_equals_a_plain_version(spark):
    df, x, y, ids, *_ = setup(spark)
    p = BCDUpdate(l1=0.1, lr=0.5, tail_feature_filter=0)
    out = train_bcd(df, BCDLearn(max_num_epochs=3, block_ratio=0.001), p, val=df)
    want, w = bcd_by_hand(x, y, p, [np.arange(len(ids))], 3)
    assert np.allclose([h["objv"] for h in out.history], want) and np.allclose([h["val_objv"] for h in out.history], want)
    got = column(out.model, "fid", "w")
    assert np.allclose([got[k] for k in ids], w)
    many = train_bcd(df, BCDLearn(max_num_epochs=1, block_ratio=0.5, random_block=0), p)
    assert many.model.select("fid").distinct().count() == len(ids)


def test_bcd_keeps_rare_groups(spark):
    """Group 5 stands in 6 rows, none of which is a tenth one, so the sample misses it."""
    rows = [(i, float(i % 2), [((7 << 12) | 1, 1.0)] + ([((9 << 12) | 5, 1.0)] if i in range(3, 63, 10) else [])) for i in range(600)]
    out = train_bcd(spark.createDataFrame(rows, ROWS), BCDLearn(max_num_epochs=1, num_feature_group_bits=12, block_ratio=1), BCDUpdate(l1=0.1))
    assert column(out.model, "fid", "cnt") == {(7 << 12) | 1: 600, (9 << 12) | 5: 6}


def by_blocks(ids, data, ratio, tail=0):
    """Columns of each block, planned from every tenth row, in the order of reversed ids."""
    nnz = sum(len(f) for i, (_, _, f) in enumerate(data) if i % 10 == 0)
    n = max(1, int(np.ceil(nnz / len(range(0, len(data), 10)) * ratio)))
    place = {k: int(f"{k:016x}"[::-1], 16) for k in ids}
    edges = [2**64 * i // n for i in range(n + 1)]
    return [np.array([j for j, k in enumerate(ids) if edges[b] <= place[k] < edges[b + 1]], int) for b in range(n)]


@pytest.mark.parametrize(("ratio", "epochs"), [(0.4, 3), (4, 1)])
def test_bcd_with_many_blocks_equals_a_plain_version(spark, ratio, epochs):
    data = fixed_rows(60, 40)
    x, y, ids = dense(data)
    p = BCDUpdate(l1=0.1, lr=0.8, tail_feature_filter=0)
    blocks = by_blocks(ids, data, ratio)
    assert len(blocks) > 1 and sum(map(len, blocks)) == len(ids)
    want, w = bcd_by_hand(x, y, p, blocks, epochs)
    out = train_bcd(spark.createDataFrame(data, ROWS), BCDLearn(max_num_epochs=epochs, block_ratio=ratio, random_block=0), p)
    assert np.allclose([h["objv"] for h in out.history], want)
    got = column(out.model, "fid", "w")
    assert np.allclose([got[k] for k in ids], w)


def test_bcd_goes_on_from_a_model(spark):
    df, x, y, ids, *_ = setup(spark, rows=20, ids=8)
    p = BCDUpdate(l1=0.1, lr=0.5, tail_feature_filter=0)
    start = np.linspace(-0.5, 0.5, len(ids))
    model = spark.createDataFrame([(k, float(a), None) for k, a in zip(ids, start)], "fid bigint, w double, v array<double>")
    out = train_bcd(df, BCDLearn(max_num_epochs=1, block_ratio=0.001), p, model=model)
    q = -y / (1 + np.exp(y * (x @ start)))
    g, u = x.T @ q, (x**2).T @ (-q * (y + q)) / p.lr + 1e-10
    d = np.where(g + p.l1 <= u * start, -(g + p.l1) / u, np.where(g - p.l1 >= u * start, -(g - p.l1) / u, -start))
    got = column(out.model, "fid", "w")
    assert np.allclose([got[k] for k in ids], start + np.clip(d, -1, 1))


def test_lbfgs_goes_on_from_a_model(spark):
    df, x, y, ids, w, v, model = setup(spark, rows=25, ids=8)
    update = LBFGSUpdate(V_dim=K, l2=0.1, V_l2=0.05, tail_feature_filter=0)
    out = train_lbfgs(df, LBFGSLearn(max_num_epochs=1, init_alpha=1e-9), update, model=model)
    got = {r.fid: r for r in out.model.collect()}
    assert all(np.isclose(got[k].w, a, atol=1e-6) and np.allclose(got[k].v, b, atol=1e-6) for k, a, b in zip(ids, w, v))


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in (-30.0, -1.0, 0.0, 0.5, 30.0, None)], "x double")
    rows = df.select("x", S.power_gradient("x", 0.5).alias("p"), S.soft_threshold("x", 1.0, F.lit(2.0)).alias("s"), S.trust_radius("x").alias("t"), S.clamp_margin("x", 1).alias("c"), S.chance("x").alias("q"), S.label_sign("x").alias("y")).collect()
    for r in rows:
        if r.x is None:
            assert r.p is None and r.y is None
            continue
        assert np.isclose(r.p, np.sign(r.x) * abs(r.x) ** 0.5) and r.c == np.clip(r.x, -20, 20)
        assert r.s == (0 if abs(r.x) <= 1 else (r.x - np.sign(r.x)) / 2) and r.t == min(5, 2 * abs(r.x) + 0.1)
        assert r.q == max(1 / (1 + np.exp(-r.x)), 1e-10) and r.y == (1 if r.x > 0 else -1)


def test_saved_models_predict_alike(spark, tmp_path):
    df, *_ = setup(spark)
    out = train_sgd(df, SGDLearn(max_num_epochs=2, stop_rel_objv=-1), SGDUpdate(l1=0.01, lr=0.5, V_dim=2, V_threshold=2))
    save_model(out, str(tmp_path / "m"), drop_zeros=True)
    again = load_model(spark, str(tmp_path / "m"))
    assert again.dim == 2 and again.history[0]["loss"] == out.history[0]["loss"]
    a, b = column(predict(df, out), "row_id", "margin"), column(predict(df, again), "row_id", "margin")
    assert len(a) == 40 and all(np.isclose(a[k], b[k]) for k in a)


#: Runs all traces to their end; else two of the L-BFGS ones end early, to save minutes.
LONG = bool(os.environ.get("MILLRACE_LONG"))


class TestFixedTraces:
    """Values known for the rows of fixed_rows, which the plain versions gave."""

    # Fixed values.
    SGD = [69.314718, 60.331520, 47.270921, 43.047173, 41.585127, 40.906563, 40.587569, 40.438212, 40.321438, 40.225487, 40.177984, 40.153580, 40.137791, 40.122551, 40.113253, 40.108936, 40.106287, 40.102501, 40.102014, 40.101274]
    BCD = [61.928106, 56.149465, 51.498637, 47.671914, 44.465575, 41.737971, 39.389395, 37.344329, 35.545670, 33.949835]
    LBFGS = [28.979599, 22.438109, 15.902945, 14.088128, 12.730421, 12.412952, 12.239838, 12.022747, 11.966372, 11.852567, 11.826917, 11.793916, 11.786716, 11.777434, 11.773214, 11.770678, 11.769601, 11.768310, 11.767978]
    TAIL = [29.005397, 22.456584, 15.891618, 14.091954, 12.715035, 12.401569, 12.231223, 12.018063, 11.960364, 11.849008, 11.823881, 11.791810, 11.784939, 11.776322, 11.772498, 11.770213, 11.769228, 11.768109, 11.767833]
    FM = [32.640192, 29.028767, 26.945617, 26.171995, 26.114639, 24.553597, 23.564241, 21.960230, 20.192795, 16.828862, 15.108317, 13.448135, 11.581154, 9.162820, 8.067699, 6.732097, 5.922363, 5.493193, 4.910675]

    def test_sgd(self, spark):
        p = SGDUpdate(l1=1, l2=1, lr=1)
        data = fixed_rows()
        x, y, ids = dense(data)
        out = train_sgd(spark.createDataFrame(data, ROWS), SGDLearn(batch_size=100, num_jobs_per_epoch=1, max_num_epochs=20, stop_rel_objv=-1), p)
        assert np.allclose([h["loss"] for h in out.history], self.SGD, atol=5e-5) and np.allclose(ftrl_by_hand(x, y, p, 20)[0], self.SGD, atol=5e-5)

    def test_bcd(self, spark):
        p = BCDUpdate(l1=0.1, lr=0.05, tail_feature_filter=0)
        data = fixed_rows()
        x, y, ids = dense(data)
        out = train_bcd(spark.createDataFrame(data, ROWS), BCDLearn(max_num_epochs=10, block_ratio=0.001), p)
        assert np.allclose([h["objv"] for h in out.history], self.BCD, rtol=1e-5) and np.allclose(bcd_by_hand(x, y, p, [np.arange(len(ids))], 10)[0], self.BCD, rtol=1e-5)

    @pytest.mark.parametrize("ratio", [0.4, 1] if LONG else [0.4])
    def test_bcd_reaches_the_optimum(self, spark, ratio):
        """Where no weight can improve the penalized loss: its slope is within l1 of 0 where the weight is 0, and l1 against the weight's sign elsewhere. Any blocks lead there."""
        p = BCDUpdate(l1=1.0, lr=0.9, tail_feature_filter=0)
        data = fixed_rows(40, 12)
        x, y, ids = dense(data)
        out = train_bcd(spark.createDataFrame(data, ROWS), BCDLearn(max_num_epochs=14, block_ratio=ratio), p)
        got = column(out.model, "fid", "w")
        w = np.array([got[k] for k in ids])
        best = bcd_by_hand(x, y, p, [np.array([j]) for j in range(len(ids))], 200)[1]
        assert np.isclose(loss(y, x @ w), loss(y, x @ best), rtol=1e-3) and ((np.abs(w) > 1e-6) == (np.abs(best) > 1e-6)).all() and 0 < (np.abs(best) > 1e-6).sum() < len(ids)
        g = x.T @ (-y / (1 + np.exp(y * (x @ best))))
        assert np.allclose(np.where(best == 0, np.clip(np.abs(g) - p.l1, 0, None), g + p.l1 * np.sign(best)), 0, atol=1e-4)

    def test_lbfgs(self, spark):
        rows = spark.createDataFrame(fixed_rows(), ROWS)
        for tail, want in ((0, self.LBFGS), (2, self.TAIL if LONG else self.TAIL[:6])):
            out = train_lbfgs(rows, LBFGSLearn(max_num_epochs=len(want), init_alpha=1, stop_rel_objv=-1), LBFGSUpdate(m=5, l2=0.01, tail_feature_filter=tail))
            assert np.allclose([h["objv"] for h in out.history], want, rtol=1e-4)

    def test_lbfgs_with_embeddings(self, spark):
        init = lambda fid, dim, scale: F.array(*(F.lit((j - dim / 2) * 0.01) for j in range(1, dim + 1)))
        want = self.FM if LONG else self.FM[:8]
        out = train_lbfgs(spark.createDataFrame(fixed_rows(), ROWS), LBFGSLearn(max_num_epochs=len(want), init_alpha=1, rho=0.5, stop_rel_objv=-1), LBFGSUpdate(m=5, V_dim=5, l2=0.1, V_l2=0.01, V_threshold=0, tail_feature_filter=0), init=init)
        assert np.allclose([h["objv"] for h in out.history], want, rtol=1e-3)


SAMPLE = os.environ.get("MILLRACE_SAMPLE", "")


class KnownTraces:
    """Values that are known for one file of 100 libsvm lines, which MILLRACE_SAMPLE names; run only where it is."""

    def rows(self, spark):
        return read(spark, SAMPLE, "libsvm").cache()

    def test_losses(self, spark):
        rows = self.rows(spark)
        e = X.triples(rows)
        assert e.count() == 9648 and e.select("fid").distinct().count() == 2775
        m = e.select("fid").distinct().select("fid", (F.col("fid") / 5e4).alias("w"), F.array(*(F.col("fid") * j / 5e5 for j in range(1, 6))).alias("v"))
        scored = losses.margins(e, rows, m)
        assert np.isclose(scored.agg(metrics.objective().alias("x")).first().x, 147.4672, rtol=1e-5)
        both = losses.gradient_and_curvature(e, scored).agg(F.sum(F.col("g") ** 2).alias("g"), F.sum(F.col("h") ** 2).alias("h")).first()
        assert np.isclose(both.g, 90.5817, rtol=1e-5) and np.isclose(both.h, 0.0424518, rtol=1e-5)
        scored = losses.margins(e, rows, m, 5)
        assert np.isclose(scored.agg(metrics.objective().alias("x")).first().x, 330.628, rtol=1e-5)
        g = losses.gradient(e, scored, m, 5).agg(F.sum(F.col("g") ** 2 + S.squared_norm("gv")).alias("x")).first().x
        assert np.isclose(g, 1.2378e3, rtol=1e-4)

    def test_sgd(self, spark):
        out = train_sgd(self.rows(spark), SGDLearn(batch_size=100, num_jobs_per_epoch=1, max_num_epochs=20, stop_rel_objv=-1), SGDUpdate(l1=1, l2=1, lr=1))
        want = [69.314718, 69.314718, 67.151912, 61.414778, 56.244989, 53.218700, 51.248737, 49.846688, 48.650164, 47.698351, 46.924038, 46.388223, 45.970721, 45.499307, 45.102245, 44.798413, 44.565211, 44.386417, 44.240657, 44.109764]
        assert np.allclose([h["loss"] for h in out.history], want, atol=5e-5)

    def test_bcd(self, spark):
        out = train_bcd(self.rows(spark), BCDLearn(max_num_epochs=10, block_ratio=0.001), BCDUpdate(l1=0.1, lr=0.05, tail_feature_filter=0))
        assert np.allclose([h["objv"] for h in out.history], [34.877064, 33.885559, 29.572740, 27.458964, 25.317689, 23.917098, 22.855843, 22.099876, 21.552682, 21.137216], rtol=1e-5)

    @pytest.mark.parametrize("ratio", [float(x) for x in os.environ.get("MILLRACE_RATIOS", "").split(",") if x])
    def test_bcd_optimum(self, spark, ratio):
        out = train_bcd(self.rows(spark), BCDLearn(max_num_epochs=50, block_ratio=ratio), BCDUpdate(l1=0.1, lr=0.8, tail_feature_filter=0))
        assert np.isclose(out.history[-1]["objv"], 15.884923, rtol=1e-3)
        assert out.model.filter("w <> 0").count() == 47

    @pytest.mark.parametrize(("tail", "want"), [
        (0, [34.603421, 12.655075, 5.224232, 2.713903, 1.290586, 0.645131, 0.317889, 0.156723, 0.075331, 0.032091, 0.018044, 0.008562, 0.004336, 0.002132, 0.001051, 0.000506, 0.000227, 0.000119, 0.000059]),
        (2, [43.865008, 21.728511, 10.893458, 5.038567, 2.293318, 1.064151, 0.518891, 0.257997, 0.128646, 0.064974, 0.028329, 0.016543, 0.007910, 0.004053, 0.002001, 0.000978, 0.000437, 0.000216, 0.000112]),
    ])
    def test_lbfgs(self, spark, tail, want):
        out = train_lbfgs(self.rows(spark), LBFGSLearn(max_num_epochs=19, init_alpha=1, stop_rel_objv=-1), LBFGSUpdate(m=5, l2=0, tail_feature_filter=tail))
        assert np.allclose([h["objv"] for h in out.history], want, atol=1e-5)

    def test_lbfgs_with_embeddings(self, spark):
        init = lambda fid, dim, scale: F.array(*(F.lit((j - dim / 2) * 0.01) for j in range(1, dim + 1)))
        out = train_lbfgs(self.rows(spark), LBFGSLearn(max_num_epochs=19, init_alpha=1, rho=0.5, stop_rel_objv=-1), LBFGSUpdate(m=5, V_dim=5, l2=0.1, V_l2=0.01, V_threshold=0, tail_feature_filter=0), init=init)
        want = [35.224265, 21.631514, 18.394319, 16.077692, 12.389012, 8.888516, 8.446880, 8.146090, 8.023501, 7.981967, 7.955119, 7.937092, 7.922456, 7.880596, 7.861660, 7.838057, 7.807892, 7.784401, 7.756756]
        assert np.allclose([h["objv"] for h in out.history], want, atol=1e-4)


if SAMPLE:
    TestKnownTraces = KnownTraces
