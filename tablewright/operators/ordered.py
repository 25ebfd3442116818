"""Order-dependent work without a one-task window.

* ``bucketed`` / ``positions``: global order over the distinct values of numeric columns. Cut points come from an
  approximate quantile sketch (a bounded list on the driver); counts inside and below buckets are exact.
* ``exact_quantiles``: linear-interpolated quantiles, sorting only the buckets that hold a wanted rank.
* ``average_ranks``: average-tie ranks of several score columns.
* ``dense_codes``: 0-based codes of the sorted distinct values of any orderable column.
* ``running``: prefix sums, maxima, minima and last values per key, with a hot key cut into blocks.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.session import written


def bucket_count(df: DataFrame) -> int:
    """As many order buckets as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


GROUPS = 64


def cut_points(nums: DataFrame, cols, n: int) -> list[list[float]]:
    """About n-quantiles of each double column: sketches per group of tasks, then of the groups' quantiles.

    At most GROUPS * n values per column meet in one task, however many tasks the scan has; cut points only place values.
    """
    wanted = [i / n for i in range(1, n)]
    grouped = nums.select(*cols, F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_g"))
    first = grouped.groupBy("_g").agg(*[F.percentile_approx(c, wanted, 4 * n).alias(c) for c in cols])
    long = first.select(F.explode(F.arrays_zip(*[F.col(c).alias(c) for c in cols])).alias("_x")).select("_x.*")
    row = long.agg(*[F.percentile_approx(c, wanted, 4 * n).alias(c) for c in cols]).first()
    return [row[c] or [] for c in cols]


def long_values(df: DataFrame, cols, extra=()) -> DataFrame:
    """(extra..., name, value, bucket) with one row per non-missing value of each numeric column."""
    n = bucket_count(df)
    nums = df.select(*extra, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    cuts = cut_points(nums, cols, n)
    outs = [f"_bucket_{c}" for c in cols]
    splits = [[-math.inf, *(sorted(set(points)) or [0.0]), math.inf] for points in cuts]
    nums = Bucketizer(splitsArray=splits, inputCols=list(cols), outputCols=outs, handleInvalid="keep").transform(nums)
    buckets = [
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.col(o).cast("int").alias("bucket")) for c, o in zip(cols, outs)
    ]
    out = nums.select(*extra, F.explode(F.array(*buckets)).alias("s"))
    # both tests are spelled out so that the counts of every later branch share one exchange
    return out.select(*extra, "s.name", "s.value", "s.bucket").where("value is not null and bucket is not null")


def grouped_values(df: DataFrame, by: Column, col: str, extra=()) -> DataFrame:
    """As ``long_values`` for one column, with the group ``by`` in place of the column name; cut points are shared."""
    kept = df.select(by.alias("group"), col, *extra)
    return long_values(kept, [col], extra=("group", *extra)).drop("name").withColumnRenamed("group", "name")


def _with_offsets(counts: DataFrame, sums) -> DataFrame:
    """Per (name, bucket): each sum, the sum in lower buckets and the total. At most columns x buckets rows."""
    per = counts.groupBy("name", "bucket").agg(*[F.sum(s).alias(s) for s in sums])
    low = W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("name")
    return per.select(
        "name", "bucket",
        *[F.col(s).alias(f"{s}_here") for s in sums],
        *[F.coalesce(F.sum(s).over(low), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(every).alias(f"{s}_total") for s in sums],
    )


def positions(long: DataFrame, sums: dict[str, Column] | None = None, offset_filter=None) -> DataFrame:
    """One row per distinct (name, value): each sum, ``<sum>_below`` over smaller values and ``<sum>_total``.

    The bucket sums come straight from the rows, by a second scan that shuffles a few rows per bucket only. With
    ``offset_filter`` the rows of other buckets are dropped before anything is shuffled by value.
    """
    sums = sums or {"n": F.lit(1)}

    def add_up(df, *by):
        return df.groupBy(*by).agg(*[F.sum(e).cast("long").alias(s) for s, e in sums.items()])

    offsets = _with_offsets(add_up(long, "name", "bucket"), list(sums))
    if offset_filter is not None:
        offsets = offsets.where(offset_filter)
    # columns x buckets rows; of ``grouped_values`` groups x buckets, so Spark decides by the measured size
    if offset_filter is not None:
        long = long.join(offsets.select("name", "bucket"), ["name", "bucket"], "left_semi")
    counts = add_up(long, "name", "bucket", "value")
    joined = counts.join(offsets, ["name", "bucket"])
    low = W.partitionBy("name", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    return joined.select(
        "name", "value",
        *[F.col(s) for s in sums],
        *[(F.col(f"{s}_before") + F.coalesce(F.sum(s).over(low), F.lit(0))).alias(f"{s}_below") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def exact_quantiles(df: DataFrame, cols, probs) -> DataFrame:
    """(name, q, quantile) by linear interpolation between the two neighbouring order statistics."""
    probs = [float(p) for p in probs]

    def rank(p, total):
        return (total - 1).cast("double") * F.lit(p)

    def holds(k, before, here):
        return (k >= before) & (k < before + here)

    wanted = F.lit(False)
    for p in probs:
        h = rank(p, F.col("n_total"))
        for k in (F.floor(h), F.ceil(h)):
            wanted = wanted | holds(k, F.col("n_before"), F.col("n_here"))
    pos = positions(long_values(df, cols), offset_filter=wanted)
    aggs = []
    for i, p in enumerate(probs):
        h = rank(p, F.col("n_total"))
        lo = F.max(F.when(holds(F.floor(h), F.col("n_below"), F.col("n")), F.col("value")))
        hi = F.max(F.when(holds(F.ceil(h), F.col("n_below"), F.col("n")), F.col("value")))
        frac = F.max(h - F.floor(h).cast("double"))
        aggs.append((lo + frac * (hi - lo)).alias(f"q{i}"))
    got = pos.groupBy("name").agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(p).alias("q"), F.col(f"q{i}").alias("quantile")) for i, p in enumerate(probs)])
    return got.select("name", F.inline(pairs))


def quantile_row(df: DataFrame, cols, probs) -> DataFrame:
    """One row with a column ``<col>_q<i>`` per column and probability."""
    q = exact_quantiles(df, cols, probs)
    picks = [
        F.max(F.when((F.col("name") == c) & (F.col("q") == float(p)), F.col("quantile"))).alias(f"{c}_q{i}")
        for c in cols
        for i, p in enumerate(probs)
    ]
    return q.agg(*picks)


def average_ranks(df: DataFrame, key: str, cols) -> DataFrame:
    """(key, name, rank): ascending average-tie rank of every score column."""
    long = long_values(df, cols, extra=(key,))
    pos = positions(long)
    ranks = pos.select("name", "value", (F.col("n_below") + (F.col("n") + 1).cast("double") / 2).alias("rank"))
    # a score shared by many rows is one hot join key; adaptive execution splits that partition
    return long.join(ranks, ["name", "value"]).select(key, "name", "rank")


def numbered(df: DataFrame, order: str, output: str) -> DataFrame:
    """``df`` with ``output``: 0-based numbers in ascending order of a column without repeated values.

    Rows are sorted in ranges and written once, so that their places hold; then the ranges' counts are carried on.
    """
    placed = written(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    low = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range, as many as shuffle partitions
    offsets = placed.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(low), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return placed.join(F.broadcast(offsets), "_range").withColumn(output, number.cast("long")).drop("_at", "_range", "_before")


def dense_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct non-null values in ascending order, numbered from 0."""
    return numbered(df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct(), "value", "code")


def in_blocks(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_block``: as many stretches of the order column as shuffle partitions, edges from its quantiles.

    The edges are doubles, which keep the order of any integers; rows that round to one double share a block.
    """
    n = bucket_count(df)
    cuts = cut_points(df.select(F.col(order).cast("double").alias("o")), ["o"], n)[0]
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    number = Bucketizer(splits=splits, inputCol="_order", outputCol="_block", handleInvalid="keep")
    placed = number.transform(df.withColumn("_order", F.col(order).cast("double")))
    return placed.drop("_order").withColumn("_block", F.col("_block").cast("long"))


_KINDS = {
    "sum": (F.sum, lambda local, carry: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(df: DataFrame, keys, order: str, measures, exclusive=(), keep_block: bool = False) -> DataFrame:
    """Running aggregates per key in the order of a unique integer column, current row included.

    ``measures`` maps a name to (kind, column) with kind sum, max or min. Names in ``exclusive`` leave the current
    row out. A key is scanned in blocks of the order column, whose edges come from the data; block totals are carried forward, so
    one hot key is spread over as many tasks as there are blocks, and a carry has at most one row per block. ``keep_block`` leaves the block column for a following scan with the
    same keys, which then finds its rows in place.
    """
    keys = list(keys)
    part = [*keys, "_block"]
    # one exchange on (keys, block) serves the row windows; the carries are block sums
    if "_block" not in df.columns:
        df = in_blocks(df, order)
    totals = df.groupBy(*part).agg(*[_KINDS[k][0](c).alias(f"_t_{m}") for m, (k, c) in measures.items()])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*part, *[_KINDS[k][0](f"_t_{m}").over(before).alias(f"_c_{m}") for m, (k, _) in measures.items()])
    base = W.partitionBy(*part).orderBy(order)
    upto = base.rowsBetween(W.unboundedPreceding, W.currentRow)
    past = base.rowsBetween(W.unboundedPreceding, -1)
    for m, (k, c) in measures.items():
        df = df.withColumn(f"_l_{m}", _KINDS[k][0](c).over(past if m in exclusive else upto))
    out = df.join(carry, part)
    for m, (k, _) in measures.items():
        out = out.withColumn(m, _KINDS[k][1](F.col(f"_l_{m}"), F.col(f"_c_{m}")))
    return out.drop(*([] if keep_block else ["_block"]), *[f"_l_{m}" for m in measures], *[f"_c_{m}" for m in measures])
