"""Projections by type or role, and set operations on columns and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.numbers import to_number
from tablewright.operators.roles import numeric_columns, string_columns


def project_numeric(df: DataFrame) -> DataFrame:
    return df.select(numeric_columns(df))


def project_features(df: DataFrame, drop) -> DataFrame:
    """Everything but the named columns; names the table does not have are ignored."""
    return df.drop(*drop)


def project_required(df: DataFrame, required, predictions=()) -> DataFrame:
    """The required columns in order, predictions as numbers; an absent column is an error."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns {absent}; required: {list(required)}")
    return df.select([to_number(c).alias(c) if c in predictions else F.col(c) for c in required])


def non_null_counts(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.agg(*[
        F.count(F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in df.columns
    ])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; one aggregate decides, one row reaches the driver."""
    counts = non_null_counts(df).first()
    return df.select([c for c in df.columns if counts[c] > 0])


def columns_only_in(first: DataFrame, second: DataFrame) -> list[str]:
    return [c for c in first.columns if c not in second.columns]


def column_check(df: DataFrame, required) -> dict[str, list[str]]:
    return {"missing": [c for c in required if c not in df.columns], "extra": [c for c in df.columns if c not in required]}


def presence(df: DataFrame, columns, label) -> DataFrame:
    """(side, column, non_null) of the listed columns, counted over the whole table."""
    frame = df.sparkSession.createDataFrame([], "side string, column string, non_null long")
    if columns:
        row = df.agg(*[F.count(c).alias(c) for c in columns])
        frame = row.unpivot([], list(columns), "column", "non_null").select(F.lit(label).alias("side"), "column", "non_null")
    return frame


def value_overlap(df: DataFrame, column: str, known) -> DataFrame:
    """Known values that occur in the column."""
    listed = df.sparkSession.createDataFrame([(k,) for k in known], "value string")
    return df.select(F.col(column).alias("value")).intersect(listed)


def union_ragged(frames) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def metric_names(df: DataFrame, metrics: str) -> DataFrame:
    """Distinct keys of a metrics map column."""
    return df.select(F.explode(F.map_keys(metrics)).alias("metric")).distinct()


def guarded_drop(df: DataFrame, bad: Column, limit: float) -> DataFrame:
    """Rows without the bad ones when their share is below the limit, else all rows; ``dropped`` tells which."""
    share = df.agg(F.coalesce(F.avg(bad.cast("double")), F.lit(0.0))).scalar()
    return df.withColumn("dropped", share < limit).where(~(F.col("dropped") & bad))
