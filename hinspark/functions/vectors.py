"""Columns over arrays of numbers and scalar activations, all built from Spark's own functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once: as a lambda's argument it isn't made again wherever f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column, eps: float = 1e-12) -> Column:
    """a / max(|a|, eps)."""
    return bound(a, lambda v: bound(F.greatest(norm(v), F.lit(eps)), lambda size: F.transform(v, lambda x: x.cast("double") / size)))


def z_scored(a: Column) -> Column:
    """(a - mean) / sample deviation; an array of fewer than two numbers, or of equal ones, becomes zeros."""
    n = F.size(a)
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), n)
    # bound as a lambda's argument, mean and deviation are made once for an array
    squares = lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m))
    stats = F.transform(F.array(mean), lambda m: F.struct(m.alias("m"), F.sqrt(F.try_divide(squares(m), n - 1)).alias("d")))
    return F.flatten(F.transform(stats, lambda t: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double") - t["m"], t["d"]), F.lit(0.0)))))


def bilinear(a: Column, w: list[list[float]], b: Column) -> Column:
    """aᵀ W b, W given as rows."""
    return dot(a, matvec(w, b))


def matvec(w: list[list[float]], x: Column) -> Column:
    return bound(x, lambda v: F.transform(F.array(*(F.array(*map(F.lit, row)) for row in w)), lambda r: dot(r, v)))


def one_hot(index: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == index).cast("double"))


def argmax(a: Column) -> Column:
    """Place of the largest element, the first on ties."""
    return F.array_position(a, F.array_max(a)) - 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def prelu(x: Column, slope: Column) -> Column:
    """Leaky relu whose slope is learned, so a column."""
    return F.when(x >= 0, x).otherwise(x * slope)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * F.expm1(x))


def gelu(x: Column) -> Column:
    """The tanh form; there is no error function among Spark's."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bce_with_logits(logit: Column, y: Column) -> Column:
    """Binary cross-entropy, stable for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def hash_uniform(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the key alone: the same in any partitioning."""
    text = F.concat_ws("-", *(k.cast("string") for k in key), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def hash_order(*key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("-", *(k.cast("string") for k in key), F.lit(str(seed))))


def human_bytes(n: Column) -> Column:
    """As in 1.5 MB."""
    out = F.format_string("%.1f TB", n / 1e12)
    for limit, unit, by in ((1e12, "GB", 1e9), (1e9, "MB", 1e6), (1e6, "KB", 1e3)):
        out = F.when(n < limit, F.format_string(f"%.1f {unit}", n / by)).otherwise(out)
    return F.when(n < 1e3, F.format_string("%d B", n.cast("long"))).otherwise(out)
