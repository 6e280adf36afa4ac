"""Queries of sparse products, losses, measures, update rules and solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.functions.ids import decode_group
from millrace.operators import features as X
from millrace.operators import linalg, metrics, updates
from millrace.operators.losses import gradient, gradient_and_curvature, margins, shifted_margins
from millrace.params import BCDLearn, BCDUpdate, LBFGSLearn, LBFGSUpdate, SGDLearn, SGDUpdate
from millrace.plans import model as keep
from millrace.plans.bcd import train_bcd
from millrace.plans.lbfgs import train_lbfgs
from millrace.plans.sgd import train_sgd
from millrace.queries.inputs import DIM, EVENTS, MARGINS, event_rows, events, labels, model
from millrace.session import Scratch, table

SGD = SGDUpdate(l1=0.5, l2=0.1, lr=0.1, V_dim=DIM, V_threshold=60, V_l2=0.01, V_lr=0.1)
BCD = BCDUpdate(l1=1.0, lr=0.9)
ANY = updates.random_vector(0)


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _places(c: str, name: str, n: int = 6) -> list:
    return [F.round(F.get(c, F.lit(j)), n).alias(f"{name}{j}") for j in range(DIM)]


def _lin(spark, d):
    return margins(events(spark, d), labels(spark, d), model(spark, d))


def _fm(spark, d):
    return margins(events(spark, d), labels(spark, d), model(spark, d), DIM)


def spmv(spark, d):
    return linalg.times(events(spark, d), model(spark, d).select("fid", F.col("w").alias("x"))).select("row_id", _r("y").alias("y"))


def spmv_trans(spark, d):
    x = labels(spark, d).select("row_id", (F.pmod("row_id", F.lit(7)) - 3).cast("double").alias("x"))
    return linalg.times(events(spark, d), x, "row_id", "fid").select("fid", _r("y", 4).alias("y"))


def spmv_add(spark, d):
    """The product added to what each row had."""
    start = labels(spark, d).select("row_id", (F.col("label") * 2 - 1).alias("y"))
    return linalg.times(events(spark, d), model(spark, d).select("fid", F.col("w").alias("x")), add=start).select("row_id", _r("y").alias("y"))


def spmm(spark, d):
    return linalg.times_columns(events(spark, d), model(spark, d).select("fid", F.col("v").alias("x")), DIM).select("row_id", *_places("y", "y"))


def spmm_trans(spark, d):
    x = labels(spark, d).select("row_id", F.array(*((F.pmod(F.col("row_id") * (j + 1), F.lit(11)) - 5).cast("double") for j in range(DIM))).alias("x"))
    return linalg.times_columns(events(spark, d), x, DIM, "row_id", "fid").select("fid", *_places("y", "y", 4))


def spmm_squares(spark, d):
    return linalg.times_columns(events(spark, d), model(spark, d).select("fid", F.col("v").alias("x")), DIM, square=True).select("row_id", *_places("y", "y", 9))


def dense_products(spark, d):
    """Vectors of a table times one another: inner products and norms of neighbours."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", _r(S.inner("a", "b")).alias("dot"), _r(S.squared_norm("a")).alias("norm"), _r(S.squared_norm(S.axpy(2.0, "a", "b"))).alias("sum_norm"), _r(S.squared_norm(S.scaled(3.0, "b"))).alias("scaled_norm"))


def logit_predict(spark, d):
    return _lin(spark, d).select("row_id", "label", _r("margin").alias("margin"))


def logit_loss(spark, d):
    return _lin(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), _r(metrics.objective(), 3).alias("loss"), _r(F.sum(S.dual("label", "margin")), 3).alias("dual"))


def logit_grad(spark, d):
    return gradient(events(spark, d), _lin(spark, d)).select("fid", _r("g", 4).alias("g"))


def logit_hess(spark, d):
    return gradient_and_curvature(events(spark, d), _lin(spark, d)).select("fid", _r("g", 4).alias("g"), _r("h", 4).alias("h"))


def logit_delta(spark, d):
    """Margins moved by a change of some weights."""
    steps = model(spark, d).select("fid", F.when(F.col("cnt") > 100, F.col("w") / 4).otherwise(0.0).alias("d"))
    return shifted_margins(events(spark, d), _lin(spark, d), steps).select("row_id", _r("margin").alias("margin"))


def fm_predict(spark, d):
    return _fm(spark, d).select("row_id", "label", _r("margin", 9).alias("margin"), *_places("xv", "xv"))


def fm_loss(spark, d):
    return _fm(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), _r(metrics.objective(), 3).alias("loss"))


def fm_grad(spark, d):
    return gradient(events(spark, d), _fm(spark, d), model(spark, d), DIM).select("fid", _r("g", 4).alias("g"), *_places("gv", "g", 4))


def scalar_functions(spark, d):
    """Clamps, powers, thresholds and radii of rounded values."""
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") / 100, 2).alias("x"))
    return x.select("key", S.clamp_margin("x", 4).alias("margin"), S.clamp_margin("x", 0).alias("as_is"), S.clamp("x", 5.0).alias("step"), _r(S.power_gradient("x", 0.5)).alias("power"), _r(S.soft_threshold("x", 10.0, F.lit(2.0))).alias("soft"), _r(S.trust_radius(F.col("x") / 10)).alias("radius"), _r(S.chance("x"), 8).alias("chance"), S.label_sign("x").alias("sign"), _r(S.logistic_loss("x", F.col("x") / 10)).alias("loss"))


def _rounded(spark, d):
    return _lin(spark, d).withColumn("margin", F.round("margin", 6))


def auc(spark, d):
    return metrics.auc(_rounded(spark, d)).select("rows", _r("auc", 8).alias("auc"), _r("auc_sum", 4).alias("auc_sum"))


def accuracy(spark, d):
    return metrics.accuracy(_rounded(spark, d), 0.25).select("rows", "correct", "acc_sum", _r("accuracy", 8).alias("accuracy"))


def logloss(spark, d):
    return _lin(spark, d).agg(_r(metrics.log_loss(), 3).alias("logloss"), _r(metrics.objective(), 3).alias("objective"))


def batch_progress(spark, d):
    """Each batch's measures."""
    b = _rounded(spark, d).withColumn("batch_id", F.floor(F.col("row_id") / 1000).cast("bigint"))
    return metrics.progress(b, ["batch_id"]).select("batch_id", "rows", _r("auc_sum", 3).alias("auc_sum"), _r("loss", 3).alias("loss"))


def merged_progress(spark, d):
    """The measures of all batches, added up."""
    b = _rounded(spark, d).withColumn("batch_id", F.floor(F.col("row_id") / 1000).cast("bigint"))
    return metrics.merged(metrics.progress(b, ["batch_id"])).select("rows", _r("auc", 6).alias("auc"), _r("loss", 3).alias("loss"))


def penalties(spark, d):
    m = model(spark, d)
    return m.agg(_r(metrics.penalty(0.5, 0.1, 0.01, DIM), 4).alias("sgd"), _r(metrics.penalty(0, 0.1, 0.02, DIM), 4).alias("lbfgs"), metrics.nonzero(DIM).alias("nnz"), metrics.nonzero().alias("nnz_w"))


def _state(spark, d):
    """A state with weights and embeddings, some steps old."""
    m = model(spark, d)
    return m.select("fid", F.col("cnt").cast("double").alias("cnt"), "w", F.lit(0.5).alias("s"), (F.col("w") * -2).alias("z"), "v", F.when(F.col("v").isNotNull(), F.array_repeat(F.lit(0.25), DIM)).alias("c"))


def ftrl_first_step(spark, d):
    """One step from a model of zeros."""
    zero = updates.new_model(X.feature_counts(events(spark, d)), 0)
    p = SGDUpdate(l1=1, l2=0.1, lr=0.5)
    scored = margins(events(spark, d), labels(spark, d), zero)
    return updates.apply_gradient(zero, gradient(events(spark, d), scored), p, ANY).select("fid", _r("w").alias("w"), _r("s", 4).alias("s"), _r("z", 4).alias("z"))


def ftrl_step(spark, d):
    """A step of a model of which some features have embeddings: weights by FTRL, embeddings by AdaGrad; a new embedding would be one of zeros."""
    s = _state(spark, d)
    scored = margins(events(spark, d), labels(spark, d), s, DIM)
    zeros = lambda fid, dim, scale: F.array_repeat(F.lit(0.0), dim)
    out = updates.apply_gradient(s, gradient(events(spark, d), scored, s, DIM), SGD, zeros)
    return out.select("fid", _r("w", 5).alias("w"), _r("s", 4).alias("s"), _r("z", 3).alias("z"), *_places("v", "v", 5), *_places("c", "c", 4))


def embedding_promotion(spark, d):
    """Counts pushed again: features with a weight that are now counted often enough get an embedding."""
    s = _state(spark, d).withColumn("w", F.when(F.pmod("fid", F.lit(3)) == 0, 0.0).otherwise(F.col("w")))
    init = lambda fid, dim, scale: F.array_repeat(F.lit(scale), dim)
    out = updates.add_counts(s, X.feature_counts(events(spark, d)), SGD, init)
    return out.select("fid", "cnt", F.col("v").isNotNull().alias("embedded"), _r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def lbfgs_dots(spark, d):
    """Inner products of three vectors over the model's table, in one pass."""
    m = model(spark, d).withColumn("g", F.transform("v", lambda x: x * x))
    pairs = {"vv": ("v", "v"), "vg": ("v", "g"), "gg": ("g", "g")}
    out = linalg.dots(m, {n: (F.col(a), F.col(b)) for n, (a, b) in pairs.items()} | {"ww": (F.col("w"), F.col("w"))})
    return out.select(*(_r(c).alias(c) for c in out.columns))


def _lbfgs(spark, d, epochs: int):
    """L-BFGS from zero without embeddings; the first step's length is given, and the line search takes what it tries first."""
    return train_lbfgs(event_rows(spark, d), LBFGSLearn(loss="logit", max_num_epochs=epochs, init_alpha=0.01, c1=-1e9, c2=1e9), LBFGSUpdate(l2=0.1, m=5))


def lbfgs_first_step(spark, d):
    """Weights after an epoch of the solver: minus the gradient, each number within 5, times the step's length."""
    return _lbfgs(spark, d, 1).model.select("fid", "cnt", _r("w").alias("w"))


def lbfgs_two_epochs(spark, d):
    """Objective per epoch of the solver; the second direction comes from the first pair of moves by the two-loop recursion."""
    out = _lbfgs(spark, d, 2)
    return spark.createDataFrame([(h["epoch"], round(h["objv"], 3), float(h["alpha"]), h["nnz_w"]) for h in out.history], "epoch int, objv double, alpha double, nnz_w bigint")


def lbfgs_linesearch(spark, d):
    """The first epoch's line search with the defaults: the steps tried, halved each time, and the objective of the one taken."""
    out = train_lbfgs(event_rows(spark, d), LBFGSLearn(loss="logit", max_num_epochs=1, init_alpha=1.0), LBFGSUpdate(l2=0.1))
    return spark.createDataFrame([(h["trials"], float(h["alpha"]), round(h["objv"], 2)) for h in out.history], "trials int, alpha double, objv double")


def sgd_minibatch(spark, d):
    """The model after an epoch of two minibatches in order, of half the rows each: the second step starts from what the first left."""
    rows = event_rows(spark, d)
    out = train_sgd(rows, SGDLearn(batch_size=max(1, -(-rows.count() // 2)), num_jobs_per_epoch=1, shuffle=0, max_num_epochs=1, loss="logit"), SGDUpdate(l1=1, l2=0.1, lr=0.5))
    return out.model.select("fid", "cnt", _r("w").alias("w"), _r("s", 4).alias("s"), _r("z", 4).alias("z"))


def sgd_jobs(spark, d):
    """The model after an epoch of four parts side by side, a batch each: what they added, put together."""
    rows = event_rows(spark, d)
    out = train_sgd(rows, SGDLearn(batch_size=max(1, rows.count()), num_jobs_per_epoch=4, shuffle=0, max_num_epochs=1, loss="logit"), SGDUpdate(l1=1, l2=0.1, lr=0.5))
    return out.model.select("fid", "cnt", _r("w").alias("w"), _r("s", 4).alias("s"), _r("z", 4).alias("z"))


def bcd_two_epochs(spark, d):
    """The model after two epochs of the solver, with all features as one block."""
    out = train_bcd(event_rows(spark, d), BCDLearn(max_num_epochs=2, block_ratio=0.001), BCD)
    return out.model.select("fid", "cnt", _r("w").alias("w"), _r("delta").alias("delta"))


def bcd_progress(spark, d):
    """Rows, loss and right rows per epoch of the same."""
    out = train_bcd(event_rows(spark, d), BCDLearn(max_num_epochs=2, block_ratio=0.001), BCD)
    return spark.createDataFrame([(h["epoch"], h["rows"], round(h["objv"], 3), h["correct"]) for h in out.history], "epoch int, rows bigint, objv double, correct bigint")


def bcd_group_steps(spark, d):
    """Newton steps of every feature from the same margins, with its group as its block, and the next radii."""
    m = model(spark, d).select("fid", "w", F.lit(1.0).alias("delta"))
    step, radius = updates.newton(p=BCD)
    both = gradient_and_curvature(events(spark, d), _lin(spark, d)).join(m, "fid")
    return both.select("fid", decode_group("fid", 12).alias("grp"), _r(step).alias("d"), _r(radius).alias("delta"))


def bcd_group_margins(spark, d):
    """Per group and row that it touches, the row's margin after that group's steps alone; other rows keep theirs."""
    steps = bcd_group_steps(spark, d).select("fid", "grp", "d")
    change = events(spark, d).join(steps, "fid").groupBy("row_id", "grp").agg(F.sum(F.col("val") * F.col("d")).alias("c"))
    return change.join(_lin(spark, d), "row_id").select("grp", "row_id", _r(F.col("margin") + F.col("c"), 8).alias("margin"))


def event_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Counts, rare features dropped, a linear model, margins, and the measures of its predictions."""
    e = events(spark, d)
    kept = X.frequent_features(X.feature_counts(e), 4)
    m = kept.select("fid", ((F.pmod(F.col("fid") * 7919, F.lit(1000)) - 500) / 1000.0).alias("w"))
    scored = margins(X.keep_features(e, kept), labels(spark, d), m).withColumn("margin", F.round("margin", 6))
    return metrics.auc(scored).select("rows", F.round("loss", 3).alias("loss"), "correct", F.round("auc", 8).alias("auc"))


def _history(spark, out):
    rows = [{k: float(v) if v is not None else None for k, v in h.items()} for h in out.history]
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} double" for n in names))


def sgd_train(spark, d):
    """Epochs of FTRL with embeddings in minibatches of all examples, in four parts, validated on every tenth."""
    rows = event_rows(spark, d)
    learn = SGDLearn(batch_size=1000, num_jobs_per_epoch=4, shuffle=4, max_num_epochs=3, stop_rel_objv=-1, stop_val_auc=-1)
    return _history(spark, train_sgd(rows, learn, SGDUpdate(l1=0.1, lr=0.5, V_dim=2, V_threshold=20), rows.filter("row_id % 10 = 0")))


def lbfgs_train(spark, d):
    return _history(spark, train_lbfgs(event_rows(spark, d), LBFGSLearn(max_num_epochs=3), LBFGSUpdate(V_dim=2, m=3)))


def bcd_train(spark, d):
    return _history(spark, train_bcd(event_rows(spark, d), BCDLearn(max_num_epochs=1, num_feature_group_bits=12, block_ratio=1), BCDUpdate(l1=0.5)))


def model_roundtrip(spark, d):
    """A trained model written, read again and used: the largest difference of its predictions."""
    rows = event_rows(spark, d)
    out = train_sgd(rows, SGDLearn(batch_size=1000, num_jobs_per_epoch=2, max_num_epochs=1), SGDUpdate(l1=0.1, lr=0.5))
    with Scratch(spark) as scratch:
        folder = scratch.folder("saved")
        keep.save_model(out, folder)
        a, b = keep.predict(rows, out), keep.predict(rows, keep.load_model(spark, folder))
        both = a.join(b.select("row_id", F.col("margin").alias("again")), "row_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col("margin") - F.col("again"))), 9).alias("differs"))
        return spark.createDataFrame([tuple(both.first())], both.schema)


QUERIES = {
    f.__name__: f
    for f in (
        event_pipeline, spmv, spmv_trans, spmv_add, spmm, spmm_trans, spmm_squares, dense_products, logit_predict, logit_loss, logit_grad, logit_hess, logit_delta, fm_predict, fm_loss, fm_grad, scalar_functions, auc, accuracy, logloss,
        batch_progress, merged_progress, penalties, ftrl_first_step, ftrl_step, embedding_promotion, lbfgs_dots, lbfgs_first_step, lbfgs_two_epochs, lbfgs_linesearch, sgd_minibatch, sgd_jobs, bcd_two_epochs, bcd_progress, bcd_group_steps, bcd_group_margins, sgd_train, lbfgs_train, bcd_train, model_roundtrip,
    )
}

_J = range(DIM)
_AUC = """SELECT sum(pos + neg)::BIGINT AS rows, sum(neg * (below + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS wrong
    FROM (SELECT *, sum(pos) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING) - pos AS below FROM (SELECT round(margin, 6) AS m, count(*) FILTER (label > 0) AS pos, count(*) FILTER (label <= 0) AS neg FROM {0} GROUP BY 1))"""
_LOSS = "greatest(-{0} * margin, 0) + ln(1 + exp(-abs(margin)))"
_STEPS = """g AS (SELECT fid, sum(val * p) AS g, sum(val * val * -p * (y + p)) AS h FROM ev JOIN ls USING (row_id) GROUP BY fid),
u AS (SELECT fid, g, h / 0.9 + 1e-10 AS u, w FROM g JOIN md USING (fid)),
st AS (SELECT fid, greatest(least(CASE WHEN g + 1 <= u * w THEN -(g + 1) / u WHEN g - 1 >= u * w THEN -(g - 1) / u ELSE -w END, 1.0), -1.0)::DOUBLE AS d FROM u)"""
#: The first gradient and direction of L-BFGS from zero, of features counted more than 4 times.
_L1 = "d1 AS (SELECT fid, cnt, sum(val * CASE WHEN label > 0 THEN -0.5 ELSE 0.5 END) AS g, greatest(least(-sum(val * CASE WHEN label > 0 THEN -0.5 ELSE 0.5 END), 5.0), -5.0)::DOUBLE AS d FROM ev JOIN cn USING (fid) WHERE cnt > 4 GROUP BY fid, cnt)"


def _scored(weights: str, name: str) -> str:
    """Margins of all rows by a table of fid, w."""
    return f"{name} AS (SELECT rw.row_id, CASE WHEN rw.label > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, coalesce(sum(val * w), 0.0)::DOUBLE AS margin FROM rw LEFT JOIN (SELECT ev.row_id, val, w FROM ev JOIN {weights} USING (fid)) USING (row_id) GROUP BY 1, 2)"


def _slope(margins: str, weights: str, name: str, l2: float = 0.1) -> str:
    """The gradient at them, with the penalty's."""
    return f"{name} AS (SELECT fid, sum(val * -y / (1 + exp(y * margin))) + {l2} * any_value(w) AS g FROM ev JOIN {margins} USING (row_id) JOIN {weights} USING (fid) GROUP BY fid)"


def _trial(k: int) -> str:
    """A trial of the line search: its objective and slope."""
    w = f"x{k} AS (SELECT fid, {0.5**k} * d AS w, d FROM d1), {_scored(f'x{k}', f'y{k}')}, {_slope(f'y{k}', f'x{k}', f'z{k}')}"
    return f"{w}, t{k} AS (SELECT (SELECT sum({_LOSS.format('y')}) FROM y{k}) + sum(0.05 * w * w) AS f, sum(z{k}.g * d) AS sl FROM x{k} JOIN z{k} USING (fid))"


def _newton(k: int) -> str:
    """A block's step from the margins m<k - 1> and weights w<k - 1>, and the margins after it."""
    return f"""n{k} AS (SELECT fid, sum(val * p) AS g, sum(val * val * -p * (y + p)) / 0.9 + 1e-10 AS u FROM ev JOIN (SELECT row_id, y, -y / (1 + exp(y * margin)) AS p FROM m{k - 1}) USING (row_id) GROUP BY fid),
    s{k} AS (SELECT fid, w, greatest(least(CASE WHEN g + 1 <= u * w THEN -(g + 1) / u WHEN g - 1 >= u * w THEN -(g - 1) / u ELSE -w END, delta), -delta)::DOUBLE AS d FROM n{k} JOIN w{k - 1} USING (fid)),
    w{k} AS (SELECT fid, w + d AS w, least(5, 2 * abs(d) + 0.1)::DOUBLE AS delta FROM s{k}), {_scored(f'w{k}', f'm{k}')}"""


_BCD = "w0 AS (SELECT fid, 0.0::DOUBLE AS w, 1.0::DOUBLE AS delta FROM cn WHERE cnt > 4), m0 AS (SELECT row_id, CASE WHEN label > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, 0.0::DOUBLE AS margin FROM rw), " + _newton(1) + ", " + _newton(2)


def _batches(by: str) -> str:
    return f"""b AS (SELECT *, row_id // 1000 AS batch_id, round(margin, 6) AS m FROM ly),
    c AS (SELECT batch_id, m, count(*) FILTER (label > 0) AS pos, count(*) FILTER (label <= 0) AS neg FROM b GROUP BY 1, 2),
    k AS (SELECT *, sum(pos) OVER (PARTITION BY batch_id ORDER BY m ROWS UNBOUNDED PRECEDING) - pos AS below FROM c),
    a AS (SELECT batch_id, sum(pos + neg)::BIGINT AS rows, sum(neg * (below + pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0) AS wrong FROM k GROUP BY 1),
    l AS (SELECT batch_id, sum({_LOSS.format('y').replace('margin', 'm')}) AS loss FROM b GROUP BY 1),
    pr AS (SELECT batch_id, rows, coalesce(rows * greatest(wrong, 1 - wrong), 1.0)::DOUBLE AS auc_sum, loss FROM a JOIN l USING (batch_id))"""


_W = "s2 AS (SELECT *, sqrt(s * s + gs * gs) AS s_new FROM s1), s3 AS (SELECT *, z - (gs - (s_new - s) / {lr} * w) AS z_new FROM s2), s4 AS (SELECT *, CASE WHEN abs(z_new) <= {l1} THEN 0.0 ELSE (z_new - sign(z_new) * {l1}) * {lr} / (1 + s_new) END::DOUBLE AS w_new FROM s3)"
SQL = {
    "event_pipeline": f"""WITH {EVENTS}, sc AS (SELECT rw.row_id, rw.label, round(coalesce(sum(val * w), 0.0), 6) AS margin FROM rw LEFT JOIN (SELECT ev.row_id, val, w FROM ev JOIN md USING (fid) WHERE cnt > 4) e ON rw.row_id = e.row_id GROUP BY 1, 2),
    a AS ({_AUC.format('sc')}) SELECT rows, (SELECT round(sum({_LOSS.format('(CASE WHEN label > 0 THEN 1 ELSE -1 END)')}), 3) FROM sc) AS loss, (SELECT count(*) FROM sc WHERE (label > 0) = (margin > 0)) AS correct, round(1 - wrong, 8) AS auc FROM a""",
    "spmv": f"WITH {EVENTS} SELECT row_id, round(sum(val * w), 6) AS y FROM ev JOIN md USING (fid) WHERE w <> 0 GROUP BY row_id",
    "spmv_trans": f"WITH {EVENTS} SELECT fid, round(sum(val * (row_id % 7 - 3)), 4) AS y FROM ev WHERE row_id % 7 <> 3 GROUP BY fid",
    "spmv_add": f"WITH {EVENTS}, p AS (SELECT row_id, sum(val * w) AS y FROM ev JOIN md USING (fid) GROUP BY row_id) SELECT row_id, round(label * 2 - 1 + coalesce(y, 0), 6) AS y FROM rw LEFT JOIN p USING (row_id)",
    "spmm": f"WITH {EVENTS} SELECT row_id, " + ", ".join(f"round(sum(val * v{j}), 6) AS y{j}" for j in _J) + " FROM ev JOIN md USING (fid) WHERE v0 IS NOT NULL GROUP BY row_id",
    "spmm_trans": f"WITH {EVENTS} SELECT fid, " + ", ".join(f"round(sum(val * ((row_id * {j + 1}) % 11 - 5)), 4) AS y{j}" for j in _J) + " FROM ev GROUP BY fid",
    "spmm_squares": f"WITH {EVENTS} SELECT row_id, " + ", ".join(f"round(sum(val * val * v{j} * v{j}), 9) AS y{j}" for j in _J) + " FROM ev JOIN md USING (fid) WHERE v0 IS NOT NULL GROUP BY row_id",
    "dense_products": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) SELECT x.vec_id, round(list_dot_product(x.a, y.a), 6) AS dot, round(list_dot_product(x.a, x.a), 6) AS norm,
    round(4 * list_dot_product(x.a, x.a) + 4 * list_dot_product(x.a, y.a) + list_dot_product(y.a, y.a), 6) AS sum_norm, round(9 * list_dot_product(y.a, y.a), 6) AS scaled_norm FROM e x JOIN e y ON x.vec_id = y.vec_id - 1""",
    "logit_predict": f"WITH {MARGINS} SELECT row_id, label, round(margin, 6) AS margin FROM lm",
    "logit_loss": f"WITH {MARGINS} SELECT label, count(*) AS rows, round(sum({_LOSS.format('y')}), 3) AS loss, round(sum(p), 3) AS dual FROM ls GROUP BY label",
    "logit_grad": f"WITH {MARGINS} SELECT fid, round(sum(val * p), 4) AS g FROM ev JOIN ls USING (row_id) GROUP BY fid",
    "logit_hess": f"WITH {MARGINS} SELECT fid, round(sum(val * p), 4) AS g, round(sum(val * val * -p * (y + p)), 4) AS h FROM ev JOIN ls USING (row_id) GROUP BY fid",
    "logit_delta": f"WITH {MARGINS}, c AS (SELECT row_id, sum(val * w / 4) AS c FROM ev JOIN md USING (fid) WHERE cnt > 100 GROUP BY row_id) SELECT row_id, round(margin + coalesce(c, 0), 6) AS margin FROM lm LEFT JOIN c USING (row_id)",
    "fm_predict": f"WITH {MARGINS} SELECT row_id, label, round(margin, 9) AS margin, " + ", ".join(f"round(s{j}, 6) AS xv{j}" for j in _J) + " FROM fm",
    "fm_loss": f"WITH {MARGINS} SELECT label, count(*) AS rows, round(sum({_LOSS.format('(CASE WHEN label > 0 THEN 1 ELSE -1 END)')}), 3) AS loss FROM fm GROUP BY label",
    "fm_grad": f"WITH {MARGINS} SELECT fid, round(sum(val * p), 4) AS g, " + ", ".join(f"round(sum(val * p * s{j}) - any_value(v{j}) * sum(val * val * p), 4) AS g{j}" for j in _J) + " FROM ev JOIN fs USING (row_id) JOIN md USING (fid) GROUP BY fid",
    "scalar_functions": """WITH c AS (SELECT c_custkey AS key, round(c_acctbal / 100, 2) AS x FROM customer) SELECT key, greatest(least(x, 20), -20)::DOUBLE AS margin, x AS as_is, greatest(least(x, 5), -5)::DOUBLE AS step, round(sign(x) * sqrt(abs(x)), 6) AS power,
    round(CASE WHEN abs(x) <= 10 THEN 0 ELSE (x - sign(x) * 10) / 2 END, 6)::DOUBLE AS soft, round(least(5, 2 * abs(x / 10) + 0.1), 6)::DOUBLE AS radius, round(greatest(1 / (1 + exp(-x)), 1e-10), 8) AS chance, (CASE WHEN x > 0 THEN 1 ELSE -1 END)::DOUBLE AS sign,
    round(greatest(-(CASE WHEN x > 0 THEN 1 ELSE -1 END) * x / 10, 0) + ln(1 + exp(-abs(x / 10))), 6) AS loss FROM c""",
    "auc": f"WITH {MARGINS}, a AS ({_AUC.format('lm')}) SELECT rows, round(1 - wrong, 8) AS auc, round(rows * greatest(wrong, 1 - wrong), 4) AS auc_sum FROM a",
    "accuracy": f"WITH {MARGINS}, c AS (SELECT count(*) AS rows, count(*) FILTER ((label > 0) = (round(margin, 6) > 0.25)) AS correct FROM lm) SELECT rows, correct, greatest(correct, rows - correct) AS acc_sum, round(correct / rows::DOUBLE, 8) AS accuracy FROM c",
    "logloss": f"WITH {MARGINS} SELECT round(sum(CASE WHEN label > 0 THEN -ln(greatest(1 / (1 + exp(-margin)), 1e-10)) ELSE -ln(1 - greatest(1 / (1 + exp(-margin)), 1e-10)) END), 3) AS logloss, round(sum({_LOSS.format('y')}), 3) AS objective FROM ly",
    "batch_progress": f"WITH {MARGINS}, {_batches('batch_id')} SELECT batch_id, rows, round(auc_sum, 3) AS auc_sum, round(loss, 3) AS loss FROM pr",
    "merged_progress": f"WITH {MARGINS}, {_batches('batch_id')} SELECT sum(rows)::BIGINT AS rows, round(sum(auc_sum) / sum(rows), 6) AS auc, round(sum(loss), 3) AS loss FROM pr",
    "penalties": f"WITH {EVENTS}, q AS (SELECT *, coalesce(v0 * v0 + v1 * v1 + v2 * v2 + v3 * v3, 0) AS vv, " + " + ".join(f"coalesce((v{j} <> 0)::INTEGER, 0)" for j in _J) + " AS nv FROM md) SELECT round(sum(0.5 * abs(w) + 0.05 * w * w + 0.005 * vv), 4) AS sgd, round(sum(0.05 * w * w + 0.01 * vv), 4) AS lbfgs, sum((w <> 0)::INTEGER + nv)::BIGINT AS nnz, sum((w <> 0)::INTEGER)::BIGINT AS nnz_w FROM q",
    "ftrl_first_step": f"""WITH {EVENTS}, s1 AS (SELECT fid, sum(val * CASE WHEN label > 0 THEN -0.5 ELSE 0.5 END) AS gs, 0.0::DOUBLE AS s, 0.0::DOUBLE AS z, 0.0::DOUBLE AS w FROM ev GROUP BY fid), {_W.format(lr='0.5', l1='1')}
    SELECT fid, round(w_new, 6) AS w, round(s_new, 4) AS s, round(z_new, 4) AS z FROM s4""",
    "ftrl_step": f"WITH {MARGINS}, gr AS (SELECT fid, any_value(w) AS w, any_value(cnt) AS cnt, " + ", ".join(f"any_value(v{j}) AS v{j}, sum(val * p * s{j}) - any_value(v{j}) * sum(val * val * p) + 0.01 * any_value(v{j}) AS g{j}" for j in _J) + f", sum(val * p) + 0.1 * any_value(w) AS gs, 0.5::DOUBLE AS s, -2 * any_value(w) AS z FROM ev JOIN fs USING (row_id) JOIN md USING (fid) GROUP BY fid), s1 AS (SELECT * FROM gr), {_W.format(lr='0.1', l1='0.5')}, f AS (SELECT *, v0 IS NULL AND cnt > 60 AND w = 0 AND w_new <> 0 AS new FROM s4) SELECT fid, round(w_new, 5) AS w, round(s_new, 4) AS s, round(z_new, 3) AS z, " + ", ".join(f"CASE WHEN new THEN 0.0 ELSE round(v{j} - 0.1 / (sqrt(0.0625 + g{j} * g{j}) + 1) * g{j}, 5) END::DOUBLE AS v{j}, CASE WHEN new THEN 0.0 ELSE round(sqrt(0.0625 + g{j} * g{j}), 4) END::DOUBLE AS c{j}" for j in _J) + " FROM f",
    "embedding_promotion": f"WITH {EVENTS}, n AS (SELECT fid, v0, CASE WHEN fid % 3 = 0 THEN 0 ELSE w END AS w, (2 * cnt)::DOUBLE AS cnt, v0 + v1 + v2 + v3 AS t FROM md) SELECT fid, cnt, v0 IS NOT NULL OR (cnt > 60 AND w <> 0) AS embedded, round(CASE WHEN v0 IS NOT NULL THEN t WHEN cnt > 60 AND w <> 0 THEN 0.04 END, 6) AS total FROM n",
    "lbfgs_dots": f"WITH {EVENTS} SELECT round(sum(" + " + ".join(f"v{j} * v{j}" for j in _J) + "), 6) AS vv, round(sum(" + " + ".join(f"v{j} * v{j} * v{j}" for j in _J) + "), 6) AS vg, round(sum(" + " + ".join(f"v{j} * v{j} * v{j} * v{j}" for j in _J) + "), 6) AS gg, round(sum(w * w), 6) AS ww FROM md",
    "lbfgs_first_step": f"WITH {EVENTS}, {_L1} SELECT fid, cnt, round(0.01 * d, 6) AS w FROM d1",
    "lbfgs_two_epochs": f"""WITH {EVENTS}, {_L1}, w1 AS (SELECT fid, 0.01 * d AS w, d, g FROM d1), {_scored('w1', 'm1')}, {_slope('m1', 'w1', 'g1')},
    p AS (SELECT g1.fid, 0.01 * d AS s, g1.g - w1.g AS y, g1.g AS g, w1.w FROM g1 JOIN w1 USING (fid)),
    a AS (SELECT sum(s * y) AS sy, sum(y * y) AS yy, -sum(s * g) AS sq FROM p), b AS (SELECT *, sq / (sy + 1e-10) AS al, sy / (yy + 1e-10) AS sc FROM a),
    q AS (SELECT fid, s, y, w, (-g - al * y) * sc AS q FROM p, b), e AS (SELECT sum(y * q) AS yq FROM q),
    w2 AS (SELECT fid, w + greatest(least(q + (al - yq / (sy + 1e-10)) * s, 5.0), -5.0) AS w FROM q, b, e), {_scored('w2', 'm2')}
    SELECT 0 AS epoch, round((SELECT sum({_LOSS.format('y')}) FROM m1) + sum(0.05 * w * w), 3)::DOUBLE AS objv, 0.01::DOUBLE AS alpha, count(*) FILTER (w <> 0) AS nnz_w FROM w1
    UNION ALL SELECT 1, round((SELECT sum({_LOSS.format('y')}) FROM m2) + sum(0.05 * w * w), 3)::DOUBLE, 1.0, count(*) FILTER (w <> 0) FROM w2""",
    "lbfgs_linesearch": f"""WITH {EVENTS}, {_L1}, {', '.join(_trial(k) for k in range(5))},
    z AS ({' UNION ALL '.join(f"SELECT {k + 1} AS trials, {0.5**k}::DOUBLE AS alpha, f, sl FROM t{k}" for k in range(5))}),
    s0 AS (SELECT sum(g * d) AS sl0, (SELECT count(*) FROM rw) * ln(2) AS f0 FROM d1)
    SELECT trials, alpha, round(f, 2)::DOUBLE AS objv FROM z, s0 WHERE f <= f0 + 1e-4 * alpha * sl0 AND sl >= 0.9::DOUBLE * sl0 OR trials = 5 ORDER BY trials LIMIT 1""",
    "sgd_minibatch": f"""WITH {EVENTS}, o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) <= (SELECT (count(*) + 1) // 2 FROM rw) AS one FROM rw),
    s1 AS (SELECT fid, sum(val * CASE WHEN label > 0 THEN -0.5 ELSE 0.5 END) AS gs, 0.0::DOUBLE AS s, 0.0::DOUBLE AS z, 0.0::DOUBLE AS w FROM ev JOIN o USING (row_id) WHERE one GROUP BY fid), {_W.format(lr='0.5', l1='1')},
    a AS (SELECT fid, w_new AS w, s_new AS s, z_new AS z FROM s4), m AS (SELECT ev.row_id, any_value(CASE WHEN label > 0 THEN 1.0 ELSE -1.0 END::DOUBLE) AS y, sum(val * coalesce(w, 0)) AS m FROM ev JOIN o USING (row_id) LEFT JOIN a USING (fid) WHERE NOT one GROUP BY ev.row_id),
    g AS (SELECT fid, sum(val * -y / (1 + exp(y * m))) AS g FROM ev JOIN m USING (row_id) GROUP BY fid), t1 AS (SELECT fid, g + 0.1 * coalesce(w, 0) AS gs, coalesce(s, 0.0) AS s, coalesce(z, 0.0) AS z, coalesce(w, 0.0) AS w FROM g LEFT JOIN a USING (fid)), {_W.replace('s1', 't1').replace('s2', 't2').replace('s3', 't3').replace('s4', 't4').format(lr='0.5', l1='1')}
    SELECT fid, cnt::DOUBLE AS cnt, round(coalesce(t4.w_new, a.w), 6) AS w, round(coalesce(t4.s_new, a.s), 4) AS s, round(coalesce(t4.z_new, a.z), 4) AS z FROM cn LEFT JOIN a USING (fid) LEFT JOIN t4 USING (fid)""",
    "sgd_jobs": f"""WITH {EVENTS}, o AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) * 4 // (SELECT count(*) FROM rw) AS part FROM rw),
    g AS (SELECT fid, part, sum(val * CASE WHEN label > 0 THEN -0.5 ELSE 0.5 END) AS g FROM ev JOIN o USING (row_id) GROUP BY fid, part), a AS (SELECT fid, sqrt(sum(g * g)) AS s, -sum(g) AS z FROM g GROUP BY fid)
    SELECT fid, cnt::DOUBLE AS cnt, round(CASE WHEN abs(z) <= 1 THEN 0.0 ELSE (z - sign(z)) * 0.5 / (1 + s) END, 6)::DOUBLE AS w, round(s, 4) AS s, round(z, 4) AS z FROM a JOIN cn USING (fid)""",
    "bcd_two_epochs": f"WITH {EVENTS}, {_BCD} SELECT fid, cnt, round(w, 6) AS w, round(delta, 6)::DOUBLE AS delta FROM w2 JOIN cn USING (fid)",
    "bcd_progress": f"""WITH {EVENTS}, {_BCD} SELECT 0 AS epoch, count(*) AS rows, round(sum({_LOSS.format('y')}), 3)::DOUBLE AS objv, count(*) FILTER ((y > 0) = (margin > 0.5)) AS correct FROM m1
    UNION ALL SELECT 1, count(*), round(sum({_LOSS.format('y')}), 3)::DOUBLE, count(*) FILTER ((y > 0) = (margin > 0.5)) FROM m2""",
    "bcd_group_steps": f"WITH {MARGINS}, {_STEPS} SELECT fid, fid & 4095 AS grp, round(d, 6) AS d, round(least(5, 2 * abs(d) + 0.1), 6) AS delta FROM st",
    "bcd_group_margins": f"WITH {MARGINS}, {_STEPS}, c AS (SELECT row_id, fid & 4095 AS grp, sum(val * round(d, 6)) AS c FROM ev JOIN st USING (fid) GROUP BY 1, 2) SELECT grp, row_id, round(margin + c, 8) AS margin FROM c JOIN lm USING (row_id)",
}
