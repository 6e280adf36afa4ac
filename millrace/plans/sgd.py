"""Stochastic gradient descent: FTRL for weights, AdaGrad for embeddings, in minibatches or over all rows at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import soft_threshold
from millrace.operators.features import batches, feature_counts, keep_negatives, triples
from millrace.operators.losses import gradient, loss_settings, margins
from millrace.operators.metrics import auc, penalty
from millrace.operators.updates import Initializer, add_counts, apply_gradient, new_model, random_vector
from millrace.params import SGDLearn, SGDUpdate
from millrace.plans.minibatch import REPORT, runner
from millrace.session import Scratch, remove


@dataclass
class Trained:
    """The model (fid, w, v and the solver's own columns), and a dict per epoch. The model's files lie beside the checkpoints until drop is called."""

    model: DataFrame
    history: list[dict] = field(default_factory=list)
    dim: int = 0
    path: str | None = None

    def drop(self) -> None:
        if self.path:
            remove(self.model.sparkSession, self.path)


def scores(entries: DataFrame, rows: DataFrame, model: DataFrame, learn, dim: int) -> DataFrame:
    return margins(entries, rows, model, **loss_settings(learn.loss, dim))


def train_sgd(
    rows: DataFrame, learn: SGDLearn = SGDLearn(), update: SGDUpdate = SGDUpdate(), val: DataFrame | None = None, init: Initializer | None = None, on_epoch: Callable[[int, dict], None] | None = None, model: DataFrame | None = None
) -> Trained:
    """rows, val: row_id, label, features.

    An epoch deals the rows in order into num_jobs_per_epoch parts, and each part's rows into batches of batch_size after shuffling within shuffle times as many. A part is one
    task's work: it takes the state of the features that the part holds, goes through its batches one after the other, each seeing what the one before it left,
    and gives what it added (see plans.minibatch). So a task holds the state of one part's features and one batch, and a step touches only the features of its batch.
    At the epoch's end the parts' additions are put together: counts, the sums z and the squared sums of gradients add up, from which weights follow; embeddings add their
    moves, each on the scale of the sum of all gradients. One part is plain sequential descent; more run side by side and see one another's steps an epoch later.
    batch_size 0: each epoch is one batch of all rows, by joins and aggregations alone.

    A batch's counts are added before its gradient, in the first epoch. Loss and AUC are taken before the update. The model is written once an epoch, so an
    executor that is lost costs a part's work at most; what an epoch replaces is deleted.
    """
    init = init or random_vector(update.seed)
    settings = loss_settings(learn.loss, update.V_dim)
    dim = settings["dim"]
    update = replace(update, V_dim=dim)  # a loss without embeddings has none, whatever is set
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        kept = rows.select("row_id", "label", "features")
        kept = keep_negatives(kept, learn.neg_sampling) if learn.neg_sampling < 1 else kept
        out = Trained(model if model is not None else new_model(spark.createDataFrame([], "fid bigint, cnt bigint"), dim), dim=dim)
        if learn.batch_size:
            data = scratch.put("rows", _laid(kept, learn, update.seed))
            touched = scratch.put("touched", data.select("part", F.explode("idx").alias("fid")).distinct())
        else:
            data = scratch.put("rows", kept)
        before: dict | None = None
        for epoch in range(learn.max_num_epochs):
            if learn.batch_size:
                record = _minibatches(scratch, out, data, touched, update, init, settings, counting=epoch == 0)
            else:
                record = _whole_batch(scratch, out, data, learn, update, init, counting=epoch == 0)
            record = {"epoch": epoch, **record, "auc": record["auc_sum"] / max(1, record["rows"])}
            if val is not None:
                record |= {f"val_{k}": v for k, v in auc(scores(triples(val), val, out.model, learn, dim)).first().asDict().items()}
            out.history.append(record)
            if on_epoch:
                on_epoch(epoch, record)
            if before and _stops(before, record, learn):
                break
            before = record
        out.path = scratch.keep("model") if out.history else None
    return out


def _laid(rows: DataFrame, learn: SGDLearn, seed: int) -> DataFrame:
    """The rows by part and batch: part, batch, label, idx, num (values)."""
    dealt = batches(rows, learn.batch_size, max(1, learn.num_jobs_per_epoch), learn.batch_size * learn.shuffle, seed)
    items = F.filter("features", lambda x: x["idx"].isNotNull())
    lists = (F.coalesce(F.transform(items, f), F.array().cast(kind)) for f, kind in ((lambda x: x["idx"], "array<bigint>"), (lambda x: F.coalesce(x["val"].cast("double"), F.lit(1.0)), "array<double>")))
    return dealt.select("part", F.col("batch_id").alias("batch"), F.col("label").cast("double").alias("label"), *(x.alias(n) for x, n in zip(lists, ("idx", "num"), strict=True)))


def _minibatches(scratch: Scratch, out: Trained, data: DataFrame, touched: DataFrame, p: SGDUpdate, init: Initializer, settings: dict, counting: bool) -> dict:
    dim = out.dim
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    vector = lambda c: [zero(F.get(c, F.lit(j))) for j in range(dim)]
    fresh = init("fid", dim, p.V_init_scale) if dim else None
    state = [zero("cnt"), zero("w"), zero("s"), zero("z"), F.col("v").isNotNull().cast("double"), *vector("v"), *vector("c"), *(F.get(fresh, F.lit(j)) for j in range(dim))]
    pulled = touched.join(out.model, "fid", "left").select("part", F.lit(-1).cast("bigint").alias("batch"), F.lit(None).cast("double").alias("label"), F.array("fid").alias("idx"), F.array(*state).alias("num"))
    each = pulled.unionByName(data).repartition("part").sortWithinPartitions("part", "batch")
    done = scratch.put("done", each.mapInArrow(runner(dim, settings["clamped"], p, counting), "fid bigint, num array<double>"))
    report = done.filter(F.col("fid").isNull()).agg(*(F.coalesce(F.sum(F.get("num", F.lit(i))), F.lit(0.0)).alias(n) for i, n in enumerate(REPORT))).first().asDict()
    names = ["_cnt", "_z", "_s", "_new", *(f"_v{j}" for j in range(dim)), *(f"_c{j}" for j in range(dim))]
    added = done.filter(F.col("fid").isNotNull()).groupBy("fid").agg(*(F.sum(F.get("num", F.lit(i))).alias(n) for i, n in enumerate(names)))
    out.model = scratch.put("model", _merged(out.model, added, p, dim, fresh))
    return report


def _merged(model: DataFrame, added: DataFrame, p: SGDUpdate, dim: int, fresh: Column | None) -> DataFrame:
    """The model with what the parts added; features that no part met stay."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = model.join(added, "fid", "full")
    met = F.col("_z").isNotNull()
    # What added 0 leaves s as it is, to the last digit.
    size = F.when(zero("_s") == 0, zero("s")).otherwise(F.sqrt(zero("s") * zero("s") + F.col("_s")))
    both = both.select("fid", (zero("cnt") + zero("_cnt")).alias("cnt"), zero("w").alias("_w"), size.alias("s"), (zero("z") + zero("_z")).alias("z"), "v", "c", met.alias("_met"), *(c for c in added.columns if c not in ("fid", "_cnt", "_z", "_s")))
    w = F.when(F.col("_met"), soft_threshold("z", p.l1, (p.lr_beta + F.col("s")) / p.lr)).otherwise(F.col("_w"))
    v, c = F.col("v"), F.col("c")
    if dim:
        start = lambda j: F.coalesce(F.get("v", F.lit(j)), F.get(fresh, F.lit(j)))
        sizes = [F.sqrt(F.coalesce(F.get("c", F.lit(j)), F.lit(0.0)) ** 2 + F.col(f"_c{j}")) for j in range(dim)]
        live = F.col("_met") & (F.col("v").isNotNull() | (F.col("_new") > 0))
        v = F.when(live, F.array(*(start(j) + F.col(f"_v{j}") / (sizes[j] + p.V_lr_beta) for j in range(dim)))).otherwise(v)
        c = F.when(live, F.array(*sizes)).otherwise(c)
    return both.select("fid", "cnt", w.alias("w"), "s", "z", v.alias("v"), c.alias("c"))


def _whole_batch(scratch: Scratch, out: Trained, data: DataFrame, learn: SGDLearn, p: SGDUpdate, init: Initializer, counting: bool) -> dict:
    entries = triples(data)
    if counting:
        out.model = scratch.put("model", add_counts(out.model, feature_counts(entries), p, init))
    scored = scratch.put("scored", scores(entries, data, out.model, learn, out.dim))
    pulled = out.model.join(entries.select("fid").distinct(), "fid", "left_semi")
    now = auc(scored).select("auc_sum", "rows", "loss").first().asDict() | pulled.agg(penalty(p.l1, p.l2, p.V_l2, out.dim).alias("penalty")).first().asDict()
    out.model = scratch.put("model", apply_gradient(out.model, gradient(entries, scored, out.model, out.dim), p, init))
    return {k: now[k] or 0 for k in REPORT}


def _stops(a: dict, b: dict, learn: SGDLearn) -> bool:
    still = a["loss"] and abs(b["loss"] - a["loss"]) / a["loss"] < learn.stop_rel_objv
    gained = "val_auc_sum" in b and b["val_rows"] and (b["val_auc_sum"] - a["val_auc_sum"]) / b["val_rows"] < learn.stop_val_auc
    return bool(still or gained)
