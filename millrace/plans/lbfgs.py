"""Limited-memory BFGS without vectors on the driver: it sees inner products only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import axpy, inner, power_gradient, scaled
from millrace.operators.features import feature_counts, frequent_features, keep_features, triples
from millrace.operators.losses import gradient, loss_settings, margins
from millrace.operators.metrics import auc, objective
from millrace.operators.updates import Initializer, clamped_direction, random_vector
from millrace.params import LBFGSLearn, LBFGSUpdate
from millrace.plans.sgd import Trained
from millrace.session import Scratch

TINY = 1e-10


def two_loop(gram: dict[frozenset, float], s: list[str], y: list[str], g: str = "g") -> dict[str, float]:
    """What each vector counts in the direction. gram: inner products by the vectors' names; s and y, the oldest first, as many of either."""
    if not s:
        return {g: -1.0}
    names = [*s, *y, g]
    dot = lambda weights, x: sum(w * gram[frozenset((n, x))] for n, w in weights.items() if w)
    weights = dict.fromkeys(names, 0.0) | {g: -1.0}
    alphas = {}
    for a, b in zip(reversed(s), reversed(y), strict=True):
        alphas[a] = dot(weights, a) / (gram[frozenset((a, b))] + TINY)
        weights[b] -= alphas[a]
    scale = gram[frozenset((s[-1], y[-1]))] / (gram[frozenset((y[-1],))] + TINY)
    weights = {n: w * scale for n, w in weights.items()}
    for a, b in zip(s, y, strict=True):
        weights[a] += alphas[a] - dot(weights, b) / (gram[frozenset((a, b))] + TINY)
    return weights


def direction(columns: dict[str, float]):
    """Their weighted sum, of array columns."""
    out = None
    for name, weight in columns.items():
        out = scaled(weight, name) if out is None else axpy(float(weight), name, out)
    return out


def _inner(a: str, b: str):
    return F.coalesce(F.sum(inner(a, b)), F.lit(0.0))


class Problem:
    """Objective and gradient at a model (fid, theta; its first number is the weight, others the embedding)."""

    def __init__(self, scratch: Scratch, entries: DataFrame, rows: DataFrame, learn: LBFGSLearn, update: LBFGSUpdate):
        self.scratch, self.entries, self.rows, self.learn, self.update = scratch, entries, rows, learn, update
        self.settings = loss_settings(learn.loss, update.V_dim)
        self.dim = self.settings["dim"]

    def named(self, model: DataFrame) -> DataFrame:
        return model.select("fid", F.get("theta", F.lit(0)).alias("w"), (F.when(F.size("theta") > 1, F.slice("theta", 2, self.dim)) if self.dim else F.lit(None)).alias("v"))

    def scored(self, model: DataFrame, entries: DataFrame, rows: DataFrame) -> DataFrame:
        return margins(entries, rows, self.named(model), **self.settings)

    def regularized(self, column: str = "theta"):
        """The share of each number in the gradient of the penalty."""
        u = self.update
        return F.transform(column, lambda x, i: F.when(i == 0, x * u.l2).otherwise(x * u.V_l2))

    def evaluate(self, model: DataFrame, name: str) -> tuple[float, float, int, DataFrame, DataFrame]:
        """The objective, its slope along d (0 where the table has no d), the numbers that aren't 0, the margins, and the gradient of all of it (fid, g), kept under the name.

        Two writes, of the margins and of the gradient, which take the sums on their way.
        """
        u = self.update
        scored = self.scratch.put("scored", self.scored(model, self.entries, self.rows), loss=objective())
        loss = self.scratch.measured["loss"] or 0.0
        grad = gradient(self.entries, scored, self.named(model), self.dim)
        zero = F.transform("theta", lambda x: F.lit(0.0))
        whole = F.concat(F.array("_g"), F.coalesce("_gv", F.array().cast("array<double>"))) if self.dim else F.array("_g")
        data = F.when(F.col("_g").isNull(), zero).otherwise(F.transform(whole, lambda x: power_gradient(x, self.learn.gamma)))
        found = grad.select("fid", F.col("g").alias("_g"), *([F.col("gv").alias("_gv")] if self.dim else []))
        out = model.join(found, "fid", "left").withColumn("g", axpy(1.0, data, self.regularized()))
        penalty = F.aggregate(F.transform("theta", lambda x, i: F.when(i == 0, x * x * u.l2 / 2).otherwise(x * x * u.V_l2 / 2)), F.lit(0.0), lambda a, x: a + x)
        slope = _inner("g", "d") if "d" in model.columns else F.max(F.lit(0.0))
        kept = self.scratch.put(name, out, only=["fid", "g"], r=F.sum(penalty), slope=slope, nnz=F.sum(F.size(F.filter("theta", lambda x: x != 0))))
        sums = self.scratch.measured
        return loss + (sums["r"] or 0.0), sums["slope"] or 0.0, sums["nnz"] or 0, scored, kept


def train_lbfgs(
    rows: DataFrame, learn: LBFGSLearn = LBFGSLearn(), update: LBFGSUpdate = LBFGSUpdate(), val: DataFrame | None = None, init: Initializer | None = None, on_epoch: Callable[[int, dict], None] | None = None, model: DataFrame | None = None
) -> Trained:
    """rows, val: row_id, label, features. One objective and gradient take two aggregations; a step's inner products are taken while its vectors are written.

    Features counted at most tail_feature_filter times in training are dropped; others get an embedding if counted more than V_threshold times. model (fid, w, v): numbers to
    start from, for the features that are kept; embeddings of another length are made anew.
    Two tables hold the model: the history (theta, its gradient and the vectors of past steps), written once an epoch, and the line search's start and direction. A trial of
    the line search writes margins and a gradient, and moves nothing else.
    """
    init = init or random_vector(update.seed, 1.0)
    with Scratch(rows.sparkSession) as scratch:
        rows, val = (None if x is None else scratch.put(n, x.select("row_id", "label", "features")) for n, x in (("rows", rows), ("val", val)))
        entries = triples(rows)
        kept = frequent_features(feature_counts(entries), update.tail_feature_filter)
        entries = scratch.put("entries", keep_features(entries, kept))
        labels = rows.select("row_id", "label")
        problem = Problem(scratch, entries, labels, learn, update)
        dim = problem.dim
        zero = F.array(F.lit(0.0))
        if model is not None:
            kept = kept.join(model.select("fid", F.col("w").alias("_w"), F.col("v").alias("_v")), "fid", "left")
            zero = F.array(F.coalesce("_w", F.lit(0.0)))
        v = init("fid", dim, update.V_init_scale) if dim else None
        if model is not None and dim:
            v = F.when(F.size("_v") == dim, F.col("_v")).otherwise(v)
        theta = F.when(F.col("cnt") > update.V_threshold, F.concat(zero, v)).otherwise(zero) if dim else zero
        past = scratch.put("past", kept.select("fid", "cnt", theta.alias("theta")))
        value, _, _, _, g = problem.evaluate(past, "grad")
        s: list[str] = []
        y: list[str] = []
        gram: dict[frozenset, float] = {}
        alpha, history, state = 0.0, [], None
        first = learn.init_alpha or labels.count() / max(1, entries.count())
        for epoch in range(learn.max_num_epochs):
            if state is None:
                past = scratch.put("past", past.join(g, "fid"))
            else:
                moved = past.join(state.select("fid", "d"), "fid").join(g.withColumnRenamed("g", "_g"), "fid")
                s, y = [*s, f"s{epoch}"][-update.m :], [*y, f"y{epoch}"][-update.m :]
                moved = moved.withColumns({y[-1]: axpy(-1.0, "g", "_g"), s[-1]: scaled(alpha, "d"), "theta": axpy(float(alpha), "d", "theta"), "g": F.col("_g")})
                fresh = [s[-1], y[-1], "g"]
                pairs = {f"d{i}": p for i, p in enumerate(sorted({tuple(sorted({a, b})) for a in fresh for b in [*s, *y, "g"]}))}
                past = scratch.put("past", moved.select("fid", "cnt", "theta", "g", *s, *y), **{n: _inner(p[0], p[-1]) for n, p in pairs.items()})
                gram |= {frozenset(p): scratch.measured[n] or 0.0 for n, p in pairs.items()}
            aimed = past.withColumn("d", direction(two_loop(gram, s, y))).withColumn("d", clamped_direction("d"))
            state = scratch.put("state", aimed.select("fid", "theta", "g", "d"), only=["fid", "theta", "d"], slope=_inner("g", "d"))
            slope = scratch.measured["slope"] or 0.0
            alpha, trial = (first if epoch == 0 else learn.alpha), 0
            while True:
                at = state.withColumn("theta", axpy(float(alpha), "d", "theta"))
                value_, slope_, nnz, scored, g = problem.evaluate(at, "grad")
                trial += 1
                if value_ <= value + learn.c1 * alpha * slope and slope_ >= learn.c2 * slope or trial >= learn.max_num_linesearchs:
                    break
                alpha *= learn.rho
            record = {"epoch": epoch, "objv": value_, "alpha": alpha, "trials": trial, "nnz_w": nnz}
            record |= auc(scored).select("auc").first().asDict()
            if val is not None:
                record["val_auc"] = auc(problem.scored(at, triples(val), val)).first().auc
            history.append(record)
            if on_epoch:
                on_epoch(epoch, record)
            done = epoch > learn.min_num_epochs and (abs(value_ - value) / max(value, 1e-300) < learn.stop_rel_objv or val is not None and (record["val_auc"] or 0) - (history[-2]["val_auc"] or 0) < learn.stop_val_auc)
            value = value_
            if done or not np.isfinite(value):
                break
        end = past.select("fid", "cnt").join(at.select("fid", "theta"), "fid") if state is not None else past
        v = F.when(F.size("theta") > 1, F.slice("theta", 2, max(1, dim)))
        out = Trained(scratch.put("model", end.select("fid", "cnt", F.get("theta", F.lit(0)).alias("w"), v.alias("v"))), history, dim)
        out.path = scratch.keep("model")
    return out
