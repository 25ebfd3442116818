"""Expressions over signal arrays (array<double> columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def let(fn, **values) -> Column:
    """``fn`` of a struct of values that are computed once per row, however often the result refers to them."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn)[0]


def minmax(arr: Column) -> Column:
    return let(
        lambda s: F.transform(s["a"], lambda v: (v - s["lo"]) / (s["hi"] - s["lo"] + EPS)),
        a=arr, lo=F.array_min(arr), hi=F.array_max(arr),
    )


def pad(arr: Column, width: int) -> Column:
    """Zeros appended or the tail cut so that the array has ``width`` elements."""
    return F.slice(F.concat(arr, F.array_repeat(F.lit(0.0), width)), 1, width)


def decibel(arr: Column) -> Column:
    return F.transform(arr, lambda v: 10.0 * F.log10(v + EPS))


def resample(arr: Column, length: int) -> Column:
    """Linear interpolation at ``length`` points evenly spaced over [0, n]; the last value holds beyond n - 1."""

    def all_points(s):
        def at(i):
            x = i.cast("double") * s["step"]
            k = F.least(F.floor(x).cast("int"), s["n"] - 1)
            left = F.element_at(s["a"], k + 1)
            right = F.element_at(s["a"], F.least(k + 2, s["n"]))
            return left + (x - k.cast("double")) * (right - left)

        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)

    n = F.size(arr)
    return F.when(n > 0, let(all_points, a=arr, n=n, step=n.cast("double") / F.lit(float(max(length - 1, 1)))))


def stack(arr: Column, channels: int = 3) -> Column:
    return F.array_repeat(arr, channels)


def real_mask(arr: Column, width: int) -> Column:
    """1 for real positions and 0 for padding."""
    return let(lambda s: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i <= s["n"]).cast("int")), n=F.size(arr))


def or_silence(arr: Column, length: int) -> Column:
    return F.coalesce(arr, F.array_repeat(F.lit(0.0), length))
