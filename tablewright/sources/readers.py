"""CSV, JSON, text and file-listing readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import fixed

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _missing_to_null(df: DataFrame) -> DataFrame:
    return df.select([F.when(~F.col(c).isin(fixed.MISSING_TEXT), F.col(c)).alias(c) for c in df.columns])


WHOLE = r"^[+-]?[0-9]+$"
LONG_DIGITS = r"^[+-]?[0-9]{1,19}$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _is_long(v):
    number = F.when(v.rlike(LONG_DIGITS), v).cast("decimal(20,0)")
    return F.coalesce(number.between(F.lit(-(2**63)).cast("decimal(20,0)"), F.lit(2**63 - 1).cast("decimal(20,0)")), F.lit(False))


def infer_types(df: DataFrame) -> T.StructType:
    """The narrowest of long, double, boolean and string that reads every value, from one aggregate over all columns.

    Patterns decide, not casts: a failed cast costs an exception per value. Integers of 19 digits are compared with the range of a
    long; a column with an integer beyond it stays text, so that no two ids become equal.
    """
    checks = []
    for i, c in enumerate(df.columns):
        v = F.col(c)
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count_if(_is_long(v)).alias(f"l{i}"),
            F.count_if(v.rlike(WHOLE) & ~_is_long(v)).alias(f"w{i}"),
            F.count_if(v.rlike(DECIMAL)).alias(f"d{i}"),
            F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}"),
        ]
    r = df.agg(*checks).first()
    fields = []
    for i, c in enumerate(df.columns):
        n = r[f"n{i}"]
        if n and r[f"l{i}"] == n:
            kind = T.LongType()
        elif r[f"w{i}"]:
            kind = T.StringType()
        elif r[f"d{i}"] == n:
            kind = T.DoubleType()  # also a column without values
        elif r[f"b{i}"] == n:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header; missing-value texts become null before types are applied.

    Pass ``schema`` in production: without it one extra aggregate over the file infers the types.
    ``multiline`` keeps line breaks inside quotes, at the price of one task per file.
    """
    raw = spark.read.options(**CSV_OPTIONS, multiLine=str(multiline).lower())
    if schema is not None:
        raw = raw.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    text = _missing_to_null(raw.csv(path))
    schema = schema or infer_types(text)
    return text.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def read_csv_safe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_csv``; a path that cannot be read gives an empty table of the same schema."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def preview(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(key).limit(n)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file below ``path`` as one whole text."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def read_json_rows(spark: SparkSession, path: str, schema, array_file: bool = False) -> DataFrame:
    """JSON lines, or files that hold one JSON array each (``array_file``)."""
    return spark.read.schema(schema).option("multiLine", str(array_file).lower()).json(path)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(root).select("path", "length")
    )
