"""Exact evaluation metrics as aggregates.

One rule for missing predictions: a metric is null as soon as one row to be judged has a null or NaN prediction or label. Every
row counts, none is left out of one term or the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import log_loss_term
from tablewright.operators.ordered import grouped_values, long_values, positions


def absent(value: Column) -> Column:
    """Null, or NaN after a cast to double."""
    return value.isNull() | F.isnan(value.cast("double"))


def when_complete(value: Column, *inputs: Column) -> Column:
    """``value``, an aggregate, or null if any row lacks one of the inputs."""
    lacking = F.lit(False)
    for i in inputs:
        lacking = lacking | absent(i)
    return F.when(F.count_if(lacking) == 0, value)


def auc(df: DataFrame, y: str, scores) -> DataFrame:
    """(name, auc) per score column, ties counted half, from class counts per distinct score; null if a score is missing."""
    counts = df.agg(*[F.count_if(absent(F.col(s)) | F.col(y).isNull()).alias(s) for s in scores])
    lacking = counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("lacking")) for s in scores])))
    found = lacking.join(_auc(long_values(df, list(scores), extra=(y,)), y), "name", "left")
    return found.select("name", F.when(F.col("lacking") == 0, F.col("auc")).alias("auc"))


def auc_by(df: DataFrame, by: Column, y: str, score: str) -> DataFrame:
    """(name, auc) of one score column per group; null for a group with one class only or with a missing score."""
    lacking = df.groupBy(by.alias("name")).agg(F.count_if(absent(F.col(score)) | F.col(y).isNull()).alias("lacking"))
    found = lacking.join(_auc(grouped_values(df, by, score, extra=(y,)), y), "name", "left")
    return found.select("name", F.when(F.col("lacking") == 0, F.col("auc")).alias("auc"))


def _auc(long: DataFrame, y: str) -> DataFrame:
    pos = positions(long, {"pos": (F.col(y) == 1).cast("long"), "neg": (F.col(y) == 0).cast("long")})
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return pos.groupBy("name").agg(F.try_divide(won, pairs).alias("auc"))


def log_loss(p: Column, y: Column) -> Column:
    """Binary: probability of the class that occurred, clipped."""
    return when_complete(F.avg(log_loss_term(F.when(y == 1, p).otherwise(1 - p))), p, y)


def multi_log_loss(probs: Column, y: Column) -> Column:
    p = F.try_element_at(probs, (y + 1).cast("int"))
    return when_complete(F.avg(log_loss_term(p)), p, y)


def accuracy(y: Column, yhat: Column) -> Column:
    return when_complete(F.avg((y == yhat).cast("double")), y, yhat)


def rmse(y: Column, yhat: Column) -> Column:
    return when_complete(F.sqrt(F.avg((y - yhat) * (y - yhat))), y, yhat)


def mae(y: Column, yhat: Column) -> Column:
    return when_complete(F.avg(F.abs(y - yhat)), y, yhat)


def f1(y: Column, yhat: Column) -> Column:
    tp = F.count_if((y == 1) & (yhat == 1))
    value = F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + F.count_if((y != 1) & (yhat == 1)) + F.count_if((y == 1) & (yhat != 1))), F.lit(0.0))
    return when_complete(value, y, yhat)


def r2(y: Column, yhat: Column) -> Column:
    return when_complete(1 - F.try_divide(F.sum((y - yhat) * (y - yhat)), F.var_pop(y) * F.count(y)), y, yhat)


#: metric: (aggregate over y and p, lower is better). AUC needs ranks and has a function of its own.
BY_NAME = {
    "log_loss": (log_loss, True),
    "accuracy": (lambda p, y: accuracy(y, F.when(absent(p), None).otherwise((p >= 0.5).cast("int"))), False),
    "f1": (lambda p, y: f1(y, F.when(absent(p), None).otherwise((p >= 0.5).cast("int"))), False),
    "rmse": (lambda p, y: rmse(y, p), True),
    "mae": (lambda p, y: mae(y, p), True),
    "r2": (lambda p, y: r2(y, p), False),
    "auc": (None, False),
}


def score_by(df: DataFrame, by: Column, metric: str, y: str, p: str) -> DataFrame:
    """(name, score) per group by the metric's name."""
    if metric not in BY_NAME:
        raise ValueError(f"unknown metric {metric}")
    if metric == "auc":
        return auc_by(df, by, y, p).withColumnRenamed("auc", "score")
    return df.groupBy(by.alias("name")).agg(BY_NAME[metric][0](F.col(p), F.col(y)).alias("score"))
