"""Exact, seeded samples, splits and folds.

Rows are ordered by md5(key:seed). Only the 1/65536 slice of rows around the cut is ranked; every other row is
decided by comparing its hash with the cut, so neither the table nor a hot stratum is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.session import written

SLICE = 4  # leading hex digits


def hash_key(key, seed) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def _cut(df: DataFrame, key: str, seed, strata, take) -> DataFrame:
    """(strata, cut): the (hash, key) of the last row to keep. ``take`` maps the stratum size to a row count."""
    h = df.select(*strata, F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k")).alias("pos"))
    h = h.withColumn("slice", F.substring("pos.h", 1, SLICE))
    per = h.groupBy(*strata, "slice").count()  # at most 65536 rows per stratum
    low = W.partitionBy(*strata).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cum = per.select(
        *strata, "slice", "count",
        F.coalesce(F.sum("count").over(low), F.lit(0)).alias("before"),
        take(F.sum("count").over(W.partitionBy(*strata))).alias("take"),
    )
    mark = cum.where((F.col("before") < F.col("take")) & (F.col("take") <= F.col("before") + F.col("count")))
    mark = mark.select(*strata, "slice", (F.col("take") - F.col("before")).alias("need"))
    # one row per stratum; without strata exactly one, else a written table of measured size
    near = h.join(written(mark) if strata else F.broadcast(mark), [*strata, "slice"])
    rank = F.row_number().over(W.partitionBy(*strata, "slice").orderBy("pos"))
    return near.withColumn("rank", rank).where(F.col("rank") == F.col("need")).select(*strata, F.col("pos").alias("cut"))


def _inside(key, seed, cut) -> Column:
    pos = F.struct(hash_key(key, seed).alias("h"), F.col(key).alias("k"))
    return F.coalesce(pos <= cut, F.lit(False))


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly round(fraction * n) rows (half to even)."""
    cut = _cut(df, key, seed, [], lambda n: F.rint(n * F.lit(fraction)).cast("long"))
    return df.where(_inside(key, seed, cut.scalar()))


def sample_cap(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """Exactly ``limit`` rows when the table has more, else all of them."""
    cut = _cut(df, key, seed, [], lambda n: F.least(n, F.lit(limit)))
    return df.where(_inside(key, seed, cut.scalar()))


def split_random(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds ``is_validation``: a row belongs to it when its hash lies below the share."""
    edge = format(int(share * 16**8), "08x")
    return df.withColumn("is_validation", F.substring(hash_key(key, seed), 1, 8) < edge)


def split_stratified(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """Adds ``is_validation``: round(share * n) rows of every label."""
    cut = written(_cut(df, key, seed, [label], lambda n: F.rint(n * F.lit(share)).cast("long")))
    return df.join(cut, label, "left").withColumn("is_validation", _inside(key, seed, F.col("cut"))).drop("cut")


def kfold_stratified(df: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1: the rank within the label, modulo k. Ranks are built per (label, hash slice).

    Only key and label are ranked; other columns are joined back by key, which is unique, and are not sorted.
    """
    others = [c for c in df.columns if c not in (key, label)]
    if others:
        folds = written(kfold_stratified(df.select(key, label), key, label, k, seed).select(key, "fold"), "folds")
        return df.join(folds, key)  # a table of measured size, so that wide rows need not be shuffled
    h = df.withColumn("_h", hash_key(key, seed)).withColumn("_s", F.substring("_h", 1, SLICE))
    per = h.groupBy(label, "_s").count()
    low = W.partitionBy(label).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(label, "_s", F.coalesce(F.sum("count").over(low), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(label, "_s").orderBy("_h", key))
    ranked = h.withColumn("_rank", inside).join(offsets, [label, "_s"])
    return ranked.withColumn("fold", F.pmod(F.col("_before") + F.col("_rank"), F.lit(k)).cast("int")).drop(
        "_h", "_s", "_before", "_rank"
    )
