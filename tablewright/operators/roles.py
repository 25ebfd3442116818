"""Column roles, submission format and modality.

Names and types come from the schema (driver metadata); everything that depends on values is one aggregate
over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import fixed
from tablewright.functions.strings import path_like

TEXTUAL = (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _named(columns, names):
    return next((c for c in columns if c.lower() in names), None)


def id_column(columns, sample_columns=()) -> str | None:
    """By name, else the first column of the sample submission, else the first column."""
    found = _named(columns, fixed.ID_NAMES)
    if found is None and sample_columns and sample_columns[0] in columns:
        found = sample_columns[0]
    return found if found is not None else (columns[0] if columns else None)


def target_column(columns, sample_columns=()) -> str | None:
    """By name, else the second column of the sample submission if the table has it, else the last column."""
    found = _named(columns, fixed.TARGET_NAMES)
    if found is None and len(sample_columns) >= 2 and sample_columns[1] in columns:
        found = sample_columns[1]
    return found if found is not None else (columns[-1] if columns else None)


def submission_id_column(columns) -> str | None:
    found = _named(columns, fixed.SUBMISSION_ID_NAMES)
    return found if found is not None else (columns[0] if columns else None)


def column_evidence(df: DataFrame, dataset: str, column: str, role: str) -> DataFrame:
    """(dataset, <role>_column, rows, nulls, distinct_values) of the chosen column."""
    c = F.col(column)
    return df.agg(
        F.lit(dataset).alias("dataset"), F.lit(column).alias(f"{role}_column"),
        F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values"),
    )


def probability_columns(df: DataFrame, columns) -> DataFrame:
    """(column, is_probability): floating type, and every non-null value within [0, 1]."""
    kinds = {f.name: f.dataType for f in df.schema}
    checks = []
    for c in columns:
        floating = isinstance(kinds[c], (T.DoubleType, T.FloatType))
        ok = (F.min(c) >= 0) & (F.max(c) <= 1) if floating else F.lit(False)
        checks.append(F.coalesce(ok, F.lit(False)).alias(c))
    return df.agg(*checks).unpivot([], list(columns), "column", "is_probability")


def submission_format(df: DataFrame, dataset: str) -> DataFrame:
    """One row: id column, prediction columns, expected kind of value and number of rows."""
    key = submission_id_column(df.columns)
    preds = [c for c in df.columns if c != key]
    first = dict(df.dtypes).get(preds[0]) if preds else None
    prob = F.lit(False)
    if first in ("double", "float"):
        prob = F.coalesce((F.min(preds[0]) >= 0) & (F.max(preds[0]) <= 1), F.lit(False))
    return df.agg(
        F.lit(dataset).alias("dataset"), F.lit(key).alias("id_column"),
        F.lit(",".join(preds) if preds else "prediction").alias("prediction_columns"),
        F.when(prob, "probability").otherwise("class").alias("expected_format"),
        F.count("*").alias("num_rows"),
    )


def has_sequence_pair(columns) -> bool:
    names = {c.lower() for c in columns}
    return any(a in names and b in names for a, b in fixed.SEQUENCE_PAIRS)


def text_normalisation(df: DataFrame, dataset: str) -> DataFrame:
    """Is this a before/after table, and do its class values meet the known tags?"""
    cls = next((c for c in df.columns if c.lower() == "class"), None)
    known = F.coalesce(F.max(F.upper(F.col(cls)).isin(fixed.NORMALISATION_CLASSES)), F.lit(False)) if cls else F.lit(False)
    pair = F.lit(has_sequence_pair(df.columns))
    return df.agg(
        F.lit(dataset).alias("dataset"), pair.alias("is_text_normalisation"), (pair & known).alias("known_classes"),
        F.count("*").alias("rows"),
    )


def heuristic_modality(df: DataFrame, dataset: str, has_image_dirs: bool = False) -> DataFrame:
    """(dataset, heuristic) from column names and from file endings in any string value."""
    names = {c.lower() for c in df.columns}
    hit = lambda words: F.lit(bool(names & set(words)))
    strings = string_columns(df)

    def any_path(ext):
        if not strings:
            return F.lit(False)
        return F.coalesce(F.greatest(*[F.max(path_like(F.col(c), ext)) for c in strings], F.lit(False)), F.lit(False))

    image = F.lit(has_image_dirs) | hit(fixed.IMAGE_COLUMNS) | F.col("image_paths")
    text, time = hit(fixed.TEXT_COLUMNS), hit(fixed.TIME_COLUMNS)
    active = image.cast("int") + text.cast("int") + time.cast("int")
    seen = df.agg(any_path(fixed.IMAGE_EXTENSIONS).alias("image_paths"), any_path(fixed.AUDIO_EXTENSIONS).alias("audio_paths"))
    return seen.select(
        F.lit(dataset).alias("dataset"),
        F.when(F.lit(has_sequence_pair(df.columns)) | hit(fixed.SEQUENCE_COLUMNS), "seq2seq")
        .when(F.col("audio_paths") | F.lit("clip" in names), "audio")
        .when(active > 1, "multimodal").when(image, "image").when(text, "text").when(time, "time_series")
        .otherwise("tabular").alias("heuristic"),
    )


def profile_modality(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, profiled) from the counts of string and numeric columns and from time-like names."""
    objects = sum(isinstance(f.dataType, TEXTUAL) for f in df.schema)
    numbers = len(numeric_columns(df))
    time = any(h in c.lower() for c in df.columns for h in fixed.TIME_HINTS)
    rest = F.lit("time_series" if time else "tabular")
    if has_sequence_pair(df.columns):
        out = F.lit("seq2seq")
    elif objects > numbers and objects > 2:
        out = F.when(F.count("*") > 0, "text").otherwise("image")
    else:
        out = rest
    return df.agg(F.count("*").alias("rows"), out.alias("profiled")).select(F.lit(dataset).alias("dataset"), "profiled", "rows")


def consensus(heuristic: DataFrame, profiled: DataFrame, verified: DataFrame) -> DataFrame:
    """(dataset, modality, confidence). ``verified`` holds (dataset, all_exist); no row means nothing to verify."""
    both = heuristic.join(profiled, "dataset").join(verified, "dataset", "left")
    same = F.col("heuristic") == F.col("profiled")
    file_based = F.col("heuristic").isin("image", "multimodal") | F.col("profiled").isin("image", "multimodal")
    exist = ~file_based | F.coalesce(F.col("all_exist"), F.lit(True))
    return both.select(
        "dataset", F.when(same, F.col("heuristic")).otherwise(F.col("profiled")).alias("modality"),
        F.when(same & exist, fixed.CONFIDENCE_VERIFIED).when(same, fixed.CONFIDENCE_UNVERIFIED)
        .otherwise(fixed.CONFIDENCE_PROFILE).alias("confidence"),
    )


def dataset_health(layout: DataFrame) -> DataFrame:
    """(dataset, is_valid, issues). Input: a layout with ``train_rows`` and ``test_rows`` (null = not counted)."""
    issues = []
    for part, label in (("train", "training"), ("test", "test")):
        none = f"No {label} data found in dataset"
        csv, folder = F.col(f"{part}_csv").isNull(), F.col(f"{part}_path").isNull()
        issues.append((1, F.when(csv & folder, none)))
        issues.append((2, F.when(csv & folder, f"Cannot load {part} data: {none}")
                       .when(csv, f"Cannot load {part} data: No CSV file found in {part}")
                       .when(F.col(f"{part}_rows") == 0, f"{part.capitalize()} data is empty")))
    ordered = [i for _, i in sorted(issues, key=lambda x: x[0])]
    found = F.filter(F.array(*ordered), lambda x: x.isNotNull())
    return layout.select("dataset", (F.size(found) == 0).alias("is_valid"), F.array_join(found, "; ").alias("issues"))


def dataset_info(train: DataFrame, test: DataFrame, sample_columns=()) -> DataFrame:
    """One row: shapes, columns, id and target of a train/test pair."""
    a = train.agg(F.count("*").alias("n"))
    b = test.agg(F.count("*").alias("n"))
    return a.select(
        F.col("n").alias("train_rows"), F.lit(len(train.columns)).alias("train_cols"),
        F.lit(",".join(train.columns)).alias("train_columns"),
        F.lit(target_column(train.columns, sample_columns)).alias("target_column"),
        b.scalar().alias("test_rows"), F.lit(len(test.columns)).alias("test_cols"),
        F.lit(",".join(test.columns)).alias("test_columns"),
        F.lit(id_column(test.columns, sample_columns)).alias("id_column"),
    )
