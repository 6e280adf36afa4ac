"""Scalar functions of losses and update rules, as column expressions. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.common import ColumnLike, col

MARGIN_BOUND, STEP_BOUND, RADIUS_BOUND = 20.0, 5.0, 5.0
LEAST_CHANCE = 1e-10


def label_sign(label: ColumnLike) -> Column:
    """1 for a positive label, else -1; so 0, -1 and 1, and any other numbers, can be labels."""
    return F.when(col(label) > 0, 1.0).when(col(label).isNotNull(), -1.0)


def logistic_loss(label: ColumnLike, margin: ColumnLike) -> Column:
    """log(1 + exp(-y m)); for large negative y m it is -y m, so nothing overflows."""
    z = -label_sign(label) * col(margin)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def dual(label: ColumnLike, margin: ColumnLike) -> Column:
    """The derivative of the logistic loss with respect to the margin."""
    y = label_sign(label)
    return -y / (1 + F.exp(y * col(margin)))


def curvature(label: ColumnLike, p: ColumnLike) -> Column:
    """The second derivative, from the first one p."""
    return -col(p) * (label_sign(label) + col(p))


def clamp(x: ColumnLike, bound: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(float(bound))), F.lit(-float(bound)))


def clamp_margin(margin: ColumnLike, dim: int) -> Column:
    """Margins of models with embeddings lie within 20 of 0; those of linear models stay as they are."""
    return clamp(margin, MARGIN_BOUND) if dim > 0 else col(margin)


def power_gradient(g: ColumnLike, gamma: float) -> Column:
    """The sign of g times its size to the power gamma."""
    return col(g) if gamma == 1 else F.signum(col(g)) * F.pow(F.abs(col(g)), F.lit(float(gamma)))


def soft_threshold(z: ColumnLike, l1: float, eta: ColumnLike) -> Column:
    """0 where z is at most l1 in size, else z drawn towards 0 by l1, over eta."""
    z = col(z)
    return F.when(F.abs(z) <= l1, 0.0).otherwise((z - F.signum(z) * l1) / col(eta))


def trust_radius(step: ColumnLike) -> Column:
    return F.least(F.lit(RADIUS_BOUND), 2 * F.abs(col(step)) + 0.1)


def chance(margin: ColumnLike) -> Column:
    """The logistic function, from 1e-10 up."""
    return F.greatest(1 / (1 + F.exp(-col(margin))), F.lit(LEAST_CHANCE))


OPERATIONS = {
    "assign": lambda a, b: b,
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "times": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
}


def combine(op: str, a: ColumnLike, b: ColumnLike) -> Column:
    """a op b, for assign, plus, minus, times and divide (null where b is 0)."""
    if op not in OPERATIONS:
        raise ValueError(f"no such operation: {op}")
    return OPERATIONS[op](col(a), col(b))


def uniform(key: ColumnLike, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key and seed alone, so a row that is computed again gets it again."""
    return F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def drawn(key: ColumnLike, seed: int) -> Column:
    """As uniform, of 52 bits of the md5 of key:seed, which any SQL engine can compute."""
    return F.conv(F.left(F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}"))), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


# Vectors as arrays of doubles.


def inner(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def axpy(alpha: ColumnLike, x: ColumnLike, y: ColumnLike) -> Column:
    """alpha x + y"""
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else col(alpha)
    return F.zip_with(col(x), col(y), lambda u, v: a * u + v)


def scaled(alpha: float, x: ColumnLike) -> Column:
    return F.transform(col(x), lambda v: v * F.lit(float(alpha)))


def squared_norm(x: ColumnLike) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v * v)
