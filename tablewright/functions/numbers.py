"""Numeric and probability expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.arrays import let


def to_number(col) -> Column:
    """Text to double; what cannot be read becomes null."""
    return F.col(col).try_cast("double") if isinstance(col, str) else col.try_cast("double")


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of doubles, which goes through decimals only where a value lies so near the middle of two results that doubles cannot tell."""
    scaled = value * float(10**digits)
    whole = F.floor(scaled)
    far = F.abs(scaled - whole.cast("double") - 0.5) > 1e-3
    return F.when((F.abs(scaled) < 1e12) & far, F.floor(scaled + 0.5).cast("double") / float(10**digits)).otherwise(F.round(value, digits))


def row_sum(cols) -> Column:
    """Sum over columns of one row; nulls add nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def normalize_probs(cols) -> list[Column]:
    """Each column divided by the row sum (null where the sum is 0)."""
    total = row_sum(cols)
    return [F.try_divide(F.col(c), total).alias(c) for c in cols]


def bad_probability_sum(cols, tolerance: float) -> Column:
    return F.abs(row_sum(cols) - 1.0) > tolerance


def softmax(arr: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    e = let(lambda s: F.transform(s["a"], lambda v: F.exp(v - s["top"])), a=arr, top=F.array_max(arr))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, w: acc + w)
    return let(lambda s: let(lambda u: F.transform(u["e"], lambda v: v / u["sum"]), e=s["e"], sum=total(s["e"])), e=e)


def argmax(arr: Column) -> Column:
    """0-based position of the largest element (first one on ties)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def focal_loss(p_true: Column, gamma: float = 2.0, alpha: float = 1.0) -> Column:
    return -F.lit(alpha) * F.pow(F.lit(1.0) - p_true, F.lit(gamma)) * F.ln(p_true)


def weighted_bce(logit: Column, y: Column, pos_weight: Column) -> Column:
    """Binary cross-entropy from logits in the form that does not overflow."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    neg_log_p = F.greatest(-logit, F.lit(0.0)) + soft
    neg_log_q = F.greatest(logit, F.lit(0.0)) + soft
    return pos_weight * y * neg_log_p + (F.lit(1.0) - y) * neg_log_q


def log_loss_term(p: Column, eps: float = 1e-15) -> Column:
    """-ln of the clipped probability; null for null and NaN, which clipping would turn into a number."""
    return F.when(p.isNotNull() & ~F.isnan(p.cast("double")), -F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))))
