"""Margins, losses' values, gradients and curvature of linear models and factorization machines.

entries: row_id, fid, val (triples); rows: row_id, label, all rows that count, also those without entries; model: fid, w, and v (an array of dim
numbers, null where the feature has no embedding) if dim is above 0. Features that the model lacks add nothing, nor do entries with a null row_id, fid or val.
A row with a null label gets a margin and has no part in gradients. Entries that stand twice count twice. Empty tables give tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import clamp_margin, curvature, dual


def margins(entries: DataFrame, rows: DataFrame, model: DataFrame, dim: int = 0, clamped: bool = True, extra: list[str] | None = None) -> DataFrame:
    """row_id, label, margin, and xv (the rows' sums of val times v) if dim is above 0.

    A factorization machine's pairs of features are summed as half of (sum)^2 - sum of squares per place of v: time linear in the entries. All sums are made in one
    aggregation. Rows without a known feature have a margin of 0. clamped: margins within 20 of 0, if dim is above 0.
    """
    places = range(dim)
    v = lambda j: F.get("v", F.lit(j))
    known = entries.select("row_id", "fid", "val").join(model.select("fid", "w", *(["v"] if dim else [])), "fid")
    sums = [F.sum(F.col("val") * F.col("w")).alias("_w")]
    for j in places:
        sums += [F.sum(F.col("val") * v(j)).alias(f"_s{j}"), F.sum(F.col("val") * F.col("val") * v(j) * v(j)).alias(f"_q{j}")]
    scored = rows.select("row_id", "label", *(extra or [])).join(known.groupBy("row_id").agg(*sums), "row_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = zero("_w")
    for j in places:
        out = out + 0.5 * (zero(f"_s{j}") * zero(f"_s{j}") - zero(f"_q{j}"))
    margin = clamp_margin(out, dim if clamped else 0)
    return scored.select("row_id", "label", *(extra or []), margin.alias("margin"), *([F.array(*(zero(f"_s{j}") for j in places)).alias("xv")] if dim else []))


def gradient(entries: DataFrame, scored: DataFrame, model: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """fid, g, and gv if dim is above 0 (null for features without v): the loss's gradient. scored: what margins gives. The clamp is not differentiated."""
    p = scored.select("row_id", dual("label", "margin").alias("p"), *(["xv"] if dim else []))
    places = range(dim)
    sums = [F.sum(F.col("val") * F.col("p")).alias("g")]
    if dim:
        sums += [F.sum(F.col("val") * F.col("p") * F.get("xv", F.lit(j))).alias(f"_s{j}") for j in places] + [F.sum(F.col("val") * F.col("val") * F.col("p")).alias("_q")]
    out = entries.select("row_id", "fid", "val").join(p, "row_id").groupBy("fid").agg(*sums)
    if not dim:
        return out
    both = out.join(model.select("fid", "v"), "fid")
    gv = F.when(F.col("v").isNotNull(), F.array(*(F.col(f"_s{j}") - F.get("v", F.lit(j)) * F.col("_q") for j in places)))
    return both.select("fid", "g", gv.alias("gv"))


def gradient_and_curvature(entries: DataFrame, scored: DataFrame) -> DataFrame:
    """fid, g, h: the linear loss's gradient and the diagonal of its Hessian, in one aggregation."""
    p = scored.select("row_id", dual("label", "margin").alias("p"), curvature("label", dual("label", "margin")).alias("c"))
    return entries.select("row_id", "fid", "val").join(p, "row_id").groupBy("fid").agg(F.sum(F.col("val") * F.col("p")).alias("g"), F.sum(F.col("val") * F.col("val") * F.col("c")).alias("h"))


def shifted_margins(entries: DataFrame, scored: DataFrame, steps: DataFrame) -> DataFrame:
    """scored with its margins moved by what a change of the weights adds: steps: fid, d. Rows that no changed feature touches stay."""
    change = entries.select("row_id", "fid", "val").join(steps.filter(F.col("d") != 0).select("fid", "d"), "fid").groupBy("row_id").agg(F.sum(F.col("val") * F.col("d")).alias("_d"))
    return scored.join(change, "row_id", "left").withColumn("margin", F.col("margin") + F.coalesce("_d", F.lit(0.0))).drop("_d")


#: Losses by name, and whether their models have embeddings and clamped margins.
LOSSES = {"logit": {"embeddings": False, "clamped": False}, "fm": {"embeddings": True, "clamped": True}, "logit_delta": {"embeddings": False, "clamped": False}}


def loss_settings(name: str, dim: int) -> dict:
    """dim and clamped for margins."""
    if name not in LOSSES:
        raise ValueError(f"no such loss: {name}")
    return {"dim": dim if LOSSES[name]["embeddings"] else 0, "clamped": LOSSES[name]["clamped"]}
