"""Update rules, as projections over a model joined with a gradient."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import clamp, soft_threshold, trust_radius, uniform
from millrace.params import BCDUpdate, SGDUpdate

#: Makes the embedding of a feature: from fid, the number of places and their scale.
Initializer = Callable[[str, int, float], Column]


def random_vector(seed: int, width: float = 0.5) -> Initializer:
    """Numbers within width times the scale of 0, from hashes of fid, place and seed."""
    return lambda fid, dim, scale: F.array(*((uniform(fid, seed * 1009 + j) - 0.5) * (2 * width * scale) for j in range(dim)))


def ftrl(w: str = "w", s: str = "s", z: str = "z", g: str = "g", p: SGDUpdate = SGDUpdate()) -> tuple[Column, Column, Column]:
    """The next w, s and z. z has the opposite of its usual sign."""
    slope = F.col(g) + p.l2 * F.col(w)
    size = F.sqrt(F.col(s) * F.col(s) + slope * slope)
    pull = F.col(z) - (slope - (size - F.col(s)) / p.lr * F.col(w))
    return soft_threshold(pull, p.l1, (p.lr_beta + size) / p.lr), size, pull


def adagrad(v: str = "v", c: str = "c", g: str = "gv", p: SGDUpdate = SGDUpdate()) -> tuple[Column, Column]:
    """The next v and c, arrays."""
    slopes = F.zip_with(g, v, lambda x, y: x + p.V_l2 * y)
    sizes = F.zip_with(c, slopes, lambda a, x: F.sqrt(a * a + x * x))
    moved = F.transform(F.arrays_zip(F.col(v).alias("v"), sizes.alias("c"), slopes.alias("g")), lambda x: x["v"] - p.V_lr / (x["c"] + p.V_lr_beta) * x["g"])
    return moved, sizes


def new_model(counts: DataFrame, dim: int) -> DataFrame:
    """fid, cnt, w, s, z, v, c: a model that knows counts only."""
    empty = F.lit(None).cast("array<double>")
    return counts.select("fid", F.col("cnt").cast("double").alias("cnt"), *(F.lit(0.0).alias(x) for x in "wsz"), empty.alias("v"), empty.alias("c"))


def add_counts(model: DataFrame, counts: DataFrame, p: SGDUpdate, init: Initializer) -> DataFrame:
    """The model with counts added, new features too; features with a weight that were counted often enough get an embedding."""
    both = model.join(counts.select("fid", F.col("cnt").alias("_n")), "fid", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counted = both.select("fid", (zero("cnt") + zero("_n")).alias("cnt"), *(zero(x).alias(x) for x in "wsz"), "v", "c")
    return promoted(counted, F.col("w") != 0, p, init)


def promoted(model: DataFrame, when: Column, p: SGDUpdate, init: Initializer) -> DataFrame:
    """Embeddings for features that have none, where the condition holds and the count is above the threshold; they are never taken away."""
    if not p.V_dim:
        return model
    due = F.col("v").isNull() & (F.col("cnt") > p.V_threshold) & when
    v = F.when(due, init("fid", p.V_dim, p.V_init_scale)).otherwise(F.col("v"))
    c = F.when(due, F.array_repeat(F.lit(0.0), p.V_dim)).otherwise(F.col("c"))
    return model.withColumns({"v": v, "c": c})


def apply_gradient(model: DataFrame, grad: DataFrame, p: SGDUpdate, init: Initializer) -> DataFrame:
    """The model after one FTRL step for w and one AdaGrad step for embeddings that were there before it; features without a gradient stay.

    A feature whose weight just left 0 gets its embedding last, so that it has no step yet.
    """
    own = ["g", *(["gv"] if p.V_dim else [])]
    both = model.join(grad.select("fid", *own), "fid", "left")
    hit = F.col("g").isNotNull()
    w, s, z = ftrl(p=p)
    columns = {"w": F.when(hit, w).otherwise(F.col("w")), "s": F.when(hit, s).otherwise(F.col("s")), "z": F.when(hit, z).otherwise(F.col("z")), "_was": F.col("w")}
    if p.V_dim:
        v, c = adagrad(p=p)
        live = F.col("gv").isNotNull() & F.col("v").isNotNull()
        columns |= {"v": F.when(live, v).otherwise(F.col("v")), "c": F.when(live, c).otherwise(F.col("c"))}
    stepped = both.withColumns(columns)
    return promoted(stepped, (F.col("_was") == 0) & (F.col("w") != 0), p, init).select("fid", "cnt", "w", "s", "z", "v", "c")


def newton(w: str = "w", g: str = "g", h: str = "h", delta: str = "delta", p: BCDUpdate = BCDUpdate()) -> tuple[Column, Column]:
    """A coordinate's step within its trust radius, and the next radius."""
    u = F.col(h) / p.lr + 1e-10
    up, down = F.col(g) + p.l1, F.col(g) - p.l1
    d = F.when(up <= u * F.col(w), -up / u).when(down >= u * F.col(w), -down / u).otherwise(-F.col(w))
    d = F.greatest(F.least(d, F.col(delta)), -F.col(delta))
    return d, trust_radius(d)


def clamped_direction(d: str) -> Column:
    return F.transform(d, lambda x: clamp(x, 5.0))
