"""Block coordinate descent with diagonal Newton steps for linear models with an l1 penalty."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import trust_radius
from millrace.operators.features import assign_blocks, every_tenth, feature_counts, frequent_features, group_counts, group_stats, in_order, keep_features, keep_negatives, plan_blocks, triples
from millrace.operators.losses import gradient_and_curvature, margins
from millrace.operators.metrics import auc, correct, objective
from millrace.operators.updates import newton
from millrace.params import BCDLearn, BCDUpdate
from millrace.plans.sgd import Trained
from millrace.session import Scratch

#: Rows in a block of the sample that plans the blocks of features: every tenth row of each.
SAMPLED = 10_000
#: Blocks whose moves are kept apart before they are added to the rows' margins.
APART = 16


class Margins:
    """The margins of all rows: a table of them, and what each block's steps have moved since it was written. A block so writes only the rows that it moves."""

    def __init__(self, scratch: Scratch, name: str, start: DataFrame):
        self.scratch, self.name, self.moves = scratch, name, []
        self.base = scratch.put(name, start)

    def now(self) -> DataFrame:
        """row_id, label, margin."""
        if not self.moves:
            return self.base
        moved = self.moves[0]
        for m in self.moves[1:]:
            moved = moved.union(m)
        both = self.base.join(moved.groupBy("row_id").agg(F.sum("move").alias("move")), "row_id", "left")
        return both.select("row_id", "label", (F.col("margin") + F.coalesce("move", F.lit(0.0))).alias("margin"))

    def shift(self, entries: DataFrame, steps: DataFrame) -> None:
        """What a change of weights adds: steps: fid, d."""
        if len(self.moves) == APART:
            self.settle()
        move = entries.select("row_id", "fid", "val").join(steps.filter(F.col("d") != 0).select("fid", "d"), "fid").groupBy("row_id").agg(F.sum(F.col("val") * F.col("d")).alias("move"))
        self.moves.append(self.scratch.put(f"{self.name}-{len(self.moves)}", move))

    def settle(self, **sums) -> dict:
        """Adds the moves to the table; sums: aggregates that the write takes on its way."""
        self.base, self.moves = self.scratch.put(self.name, self.now(), **sums), []
        return self.scratch.measured


def train_bcd(rows: DataFrame, learn: BCDLearn = BCDLearn(), update: BCDUpdate = BCDUpdate(), val: DataFrame | None = None, on_epoch: Callable[[int, dict], None] | None = None, model: DataFrame | None = None) -> Trained:
    """rows, val: row_id, label, features. Margins are kept and moved by each block's steps; blocks are ranges of reversed ids, in an order that the seed gives.

    The blocks are planned from the entries of every tenth row, rare features included; a group that the sample misses and that has features to train gets one block.
    A block's step reads its own entries and the rows' margins, and writes its weights and the moves of the rows that it touches. model (fid, w): weights to start from.
    The loss reported is without the penalty, after an epoch's last block; validation rows are reported apart.
    """
    with Scratch(rows.sparkSession) as scratch:
        rows = keep_negatives(rows, learn.neg_sampling) if learn.neg_sampling < 1 else rows
        rows, val = (None if x is None else scratch.put(n, x.select("row_id", "label", "features")) for n, x in (("rows", rows), ("val", val)))
        everything = triples(rows)
        kept = scratch.put("kept", frequent_features(feature_counts(everything), update.tail_feature_filter))
        sample = scratch.put("sample", every_tenth(in_order(rows.select("row_id"), SAMPLED), "batch_id").select("row_id"))
        bits = learn.num_feature_group_bits
        # At most 2^16 groups.
        stats = {r.grp: 0 for r in group_counts(kept, bits).collect()} | {r.grp: r.nnz for r in group_stats(everything, sample, bits).collect()}
        plan = plan_blocks({g: n or 1e-9 for g, n in stats.items()}, sample.count(), bits, learn.block_ratio)
        blocks = list(range(len(plan)))
        # In the order of blocks, so that a block's step reads its own row groups only.
        entries = scratch.put("entries", assign_blocks(keep_features(everything, kept), plan), "fblk")
        tests = scratch.put("tests", assign_blocks(triples(val), plan), "fblk") if val is not None else None
        first = model.select("fid", F.col("w").alias("_w")) if model is not None else kept.select("fid", F.lit(0.0).alias("_w")).limit(0)
        start = assign_blocks(kept, plan).join(first, "fid", "left").select("fid", "cnt", "fblk", F.coalesce("_w", F.lit(0.0)).alias("w"), F.lit(1.0).alias("delta"))
        start = scratch.put("start", start)
        models: dict[int, DataFrame] = {}
        begin = lambda e, x: margins(e, x, start) if model is not None else x.select("row_id", "label", F.lit(0.0).alias("margin"))
        scored, tested = Margins(scratch, "scored", begin(entries, rows)), Margins(scratch, "tested", begin(tests, val)) if val is not None else None
        out, order = Trained(start), random.Random(learn.seed)
        for epoch in range(learn.max_num_epochs):
            if learn.random_block:
                order.shuffle(blocks)
            for b in blocks:
                part = entries.filter(F.col("fblk") == b)
                mine = models.get(b, start.filter(F.col("fblk") == b)).drop("d")
                both = mine.join(gradient_and_curvature(part, scored.now()), "fid", "left").na.fill(0.0, ["g", "h"])
                d, _ = newton(p=update)
                stepped = both.withColumn("d", d).select("fid", "cnt", "fblk", (F.col("w") + F.col("d")).alias("w"), trust_radius("d").alias("delta"), "d")
                models[b] = scratch.put(f"model-{b}", stepped)
                scored.shift(part, models[b])
                if tested:
                    tested.shift(tests.filter(F.col("fblk") == b), models[b])
            sums = {"rows": F.count(F.lit(1)), "objv": objective(), "correct": correct(0.5)}
            record = {"epoch": epoch} | scored.settle(**sums) | auc(scored.base).select("auc", "auc_sum").first().asDict()
            if tested:
                record |= {f"val_{k}": v for k, v in (tested.settle(**sums) | auc(tested.base).select("auc").first().asDict()).items()}
            out.history.append(record)
            if on_epoch:
                on_epoch(epoch, record)
        whole = rows.sparkSession.read.parquet(*(scratch.paths[f"model-{b}"] for b in blocks)) if models else start
        out.model = scratch.put("model", whole.select("fid", "cnt", "w", F.lit(None).cast("array<double>").alias("v"), "delta"))
        out.path = scratch.keep("model")
    return out
