"""Table profile: null shares, distributions, correlations, sizes, target type."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import fixed
from tablewright.operators.roles import numeric_columns

WIDTHS = {"bigint": 8, "double": 8, "int": 4, "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "timestamp": 8,
          "timestamp_ntz": 8, "date": 4}
PAIR_CHUNK = 400


def _missing(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return (F.col(c).isNull() | F.isnan(c)) if kind in ("double", "float") else F.col(c).isNull()


def _clean(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.nanvl(F.col(c), F.lit(None)) if kind in ("double", "float") else F.col(c).cast("double")


def profile_types(df: DataFrame) -> DataFrame:
    """(column, type, non_null) for every column; the counts are one aggregate."""
    counts = df.agg(*[F.count_if(~_missing(df, c)).alias(c) for c in df.columns])
    kinds = F.create_map(*[F.lit(x) for c, k in df.dtypes for x in (c, k)])
    return counts.unpivot([], df.columns, "column", "non_null").select("column", kinds[F.col("column")].alias("type"), "non_null")


def null_share(df: DataFrame) -> DataFrame:
    """(column, share) where share > 0."""
    row = df.agg(*[F.avg(_missing(df, c).cast("double")).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "share").where(F.col("share") > 0)


def has_distribution(df: DataFrame, target: str) -> bool:
    return isinstance(df.schema[target].dataType, (T.IntegralType, T.StringType))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, n) of an integer or string target; an empty table for other types."""
    keep = F.col(target).isNotNull() if has_distribution(df, target) else F.lit(False)
    return df.where(keep).groupBy(F.col(target).cast("string").alias("value")).agg(F.count("*").alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows where both are present; null when one side is constant or absent."""
    return F.try_divide(F.regr_sxy(x, y), F.sqrt(F.regr_sxx(x, y) * F.regr_syy(x, y)))


def correlations(df: DataFrame, cols=None) -> DataFrame:
    """(first, second, r) for every pair of numeric columns in column order.

    One aggregate per chunk of pairs: up to 28 columns that is a single pass over the table.
    """
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    out = None
    for at in range(0, len(pairs), PAIR_CHUNK):
        part = pairs[at:at + PAIR_CHUNK]
        row = df.agg(*[correlation(_clean(df, a), _clean(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        items = F.array(*[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r"), F.lit(at + i).alias("position"))
            for i, (a, b) in enumerate(part)
        ])
        rows = row.select(F.inline(items))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = df.sparkSession.createDataFrame([], "first string, second string, r double, position int")
    return out.where(F.col("r").isNotNull())


def strong_correlations(df: DataFrame, cols=None, limit: float = fixed.STRONG_CORRELATION) -> DataFrame:
    return correlations(df, cols).where(F.abs("r") > limit).drop("position")


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value: fixed widths, the encoded length of strings and binaries, the sum over parts of nested values."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        size = value_bytes(F.map_keys(value), keys) + value_bytes(F.map_values(value), values)
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    else:
        return F.lit(WIDTHS.get(kind.simpleString(), 16 if isinstance(kind, T.DecimalType) else 0)).cast("long")
    return F.coalesce(size.cast("long"), F.lit(0).cast("long"))


def row_bytes(df: DataFrame) -> Column:
    return sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))


def profile_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("num_samples"), F.lit(len(df.columns)).alias("num_features"))


def profile_bytes(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(row_bytes(df)).alias("bytes"))


def class_imbalance(dist: DataFrame) -> DataFrame:
    """(num_classes, imbalance): largest over smallest class; 1.0 below two classes."""
    return dist.agg(
        F.count("*").alias("num_classes"),
        F.when(F.count("*") < 2, 1.0).otherwise(F.max("n") / F.min("n")).alias("imbalance"),
    )


def target_type(num_classes: Column, modality: str = "tabular") -> Column:
    """With a distribution by its size; without one (0 classes) by modality."""
    fallback = "sequence" if modality == "time_series" else "classification"
    return (
        F.when(num_classes == 0, fallback).when(num_classes < fixed.CLASS_LIMIT, "classification").otherwise("regression")
    )


def task_metric(df: DataFrame, target: str) -> DataFrame:
    """(num_classes, task, metric) of a target column."""
    discrete = has_distribution(df, target)
    n = F.col("num_classes")
    few = F.lit(discrete) & (n < fixed.CLASS_LIMIT)
    return df.agg(F.count_distinct(target).alias("num_classes")).select(
        n, F.when(few, "classification").otherwise("regression").alias("task"),
        F.when(few & (n == 2), "roc_auc").when(few, "log_loss").otherwise("r2").alias("metric"),
    )


def loss_choice(kind: Column, imbalance: Column) -> Column:
    return (
        F.when(kind == "regression", "MSE").when(kind == "sequence", "CrossEntropy")
        .when(imbalance > fixed.IMBALANCE_LIMIT, "FocalLoss").otherwise("CrossEntropy")
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias("distinct_values"))


def dataset_profile(df: DataFrame, target: str, modality: str = "tabular", digits: int = 6) -> DataFrame:
    """The whole profile as one row: one pass for sizes, nulls and correlations, one for the class counts.

    Class counts themselves stay a table (``class_distribution``); the record carries what is decided from them.
    """
    numbers = numeric_columns(df)
    pairs = list(combinations(numbers, 2))
    one_pass = len(pairs) <= PAIR_CHUNK  # beyond it the pairs take passes of their own
    row = df.agg(
        F.count("*").alias("num_samples"), F.sum(row_bytes(df)).alias("bytes"),
        *[F.avg(_missing(df, c).cast("double")).alias(f"m_{c}") for c in df.columns],
        *[correlation(_clean(df, a), _clean(df, b)).alias(f"r_{a}_{b}") for a, b in pairs if one_pass],
    )

    def listing(items, keep):
        texts = [F.when(keep(F.col(col)), F.concat(F.lit(f"{name}="), F.format_string(f"%.{digits}f", F.col(col)))) for name, col in items]
        return F.array_join(F.filter(F.array(*texts), lambda x: x.isNotNull()), ";") if texts else F.lit("")

    if one_pass:
        strong = listing([(f"{a}_{b}", f"r_{a}_{b}") for a, b in pairs], lambda v: F.abs(v) > fixed.STRONG_CORRELATION)
    else:
        found = correlations(df, numbers).where(F.abs("r") > fixed.STRONG_CORRELATION)
        item = F.format_string(f"%s_%s=%.{digits}f", "first", "second", "r").alias("text")
        ordered = F.array_sort(F.collect_list(F.struct("position", item)))  # at most one entry per pair of columns
        strong = found.agg(F.array_join(F.transform(ordered, lambda e: e["text"]), ";")).scalar()
    classes = class_imbalance(class_distribution(df, target)).select(F.struct("num_classes", "imbalance")).scalar()
    n, imb = F.col("classes.num_classes"), F.col("classes.imbalance")
    base = row.withColumn("classes", classes)
    return base.select(
        "num_samples", F.lit(len(df.columns)).alias("num_features"), "bytes",
        F.lit(";".join(f"{c}={k}" for c, k in df.dtypes)).alias("data_types"),
        listing([(c, f"m_{c}") for c in df.columns], lambda v: v > 0).alias("missing"),
        strong.alias("correlations"),
        n.alias("num_classes"), F.round(imb, digits).alias("imbalance"),
        target_type(n, modality).alias("target_type"),
        loss_choice(target_type(n, modality), imb).alias("loss"),
    )
