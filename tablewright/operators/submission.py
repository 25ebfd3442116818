"""Submission tables: build, lay out, validate, save, grade."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions.numbers import bad_probability_sum, row_sum
from tablewright.operators import lookups as lk
from tablewright.operators import metrics
from tablewright.operators.columns import column_check, project_required
from tablewright.operators.ordered import running
from tablewright.session import file_system, written
from tablewright.sources.readers import read_csv
from tablewright.sources.writers import submission_name, write_csv


def predictions_table(scored: DataFrame, key: str, predictions, order: str | None = None) -> DataFrame:
    """Id and prediction columns; several predictions are scaled to sum 1.

    A table without the id column gets consecutive ids in the order of the integer column ``order``.
    """
    if key not in scored.columns:
        scored = running(scored.withColumn("_all", F.lit(0)), ["_all"], order, {key: ("sum", F.lit(1))}).withColumn(key, F.col(key) - 1)
    if len(predictions) > 1:
        total = row_sum(predictions)
        return scored.select(key, *[F.try_divide(F.col(c), total).alias(c) for c in predictions])
    return scored.select(key, *predictions)


def wide_probabilities(long: DataFrame, classes) -> DataFrame:
    """One probability column per class, classes in ascending order, from (id, class, p)."""
    return long.groupBy("id").pivot("class", sorted(classes)).agg(F.first("p"))


def validate_submission(sub: DataFrame, key: str, predictions, test: DataFrame | None = None) -> DataFrame:
    """One row (is_valid, errors, warnings): columns, nulls, row count, repeated ids, probability sums.

    Rows are first combined per id, so repeated ids are found without a distinct count.
    """
    required = [key, *predictions]
    names = column_check(sub, required)
    preds = [c for c in predictions if c in sub.columns]
    kinds = dict(sub.dtypes)
    null = {c: (F.col(c).isNull() | F.isnan(c)) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in preds}
    sums = bad_probability_sum(preds, fixed.SUM_TOLERANCE) if len(predictions) > 1 and preds else F.lit(False)
    by = [key] if key in sub.columns else []
    per = sub.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(sums).alias("bad_sums"), *[F.count_if(null[c]).alias(f"null_{c}") for c in preds]
    )
    total = per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - 1) if by else F.lit(0), F.lit(0)).alias("copies"),
        F.coalesce(F.sum("bad_sums"), F.lit(0)).alias("bad_sums"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in preds],
    )
    c, text = F.col, lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    errors = [F.lit("Missing required columns: " + ", ".join(sorted(names["missing"])) if names["missing"] else None)]
    errors += [F.when(c(f"null_{p}") > 0, text(f"Column '{p}' has ", c(f"null_{p}"), " missing values")) for p in preds]
    if test is not None:
        total = total.withColumn("expected", test.agg(F.count("*")).scalar())
        mismatch = text("Row count mismatch: expected ", c("expected"), ", got ", c("rows"))
        errors.append(F.when(c("expected") != c("rows"), mismatch))
    errors.append(F.when(c("copies") > 0, text("Found ", c("copies"), " duplicate IDs")))
    extra = "Extra columns present (will be ignored): " + ", ".join(sorted(names["extra"])) if names["extra"] else None
    warnings = [F.lit(extra), F.when(c("bad_sums") > 0, text(c("bad_sums"), " rows have probabilities not summing to 1"))]

    def present(items):
        return F.filter(F.array(*[i.cast("string") for i in items]), lambda x: x.isNotNull())

    found = total.select(present(errors).alias("errors"), present(warnings).alias("warnings"))
    return found.select((F.size("errors") == 0).alias("is_valid"), "errors", "warnings")


def save_submission(df: DataFrame, key: str, predictions, test: DataFrame, folder: str, stamp: str, strategy=None, seed=None) -> str:
    """Format, validate and write; a submission with errors is not written."""
    formatted = project_required(df, [key, *predictions], predictions)
    report = validate_submission(formatted, key, predictions, test).first()
    if not report["is_valid"]:
        raise ValueError("invalid submission: " + "; ".join(report["errors"]))
    return write_csv(formatted, f"{folder}/{submission_name(stamp, strategy, seed)}")


def publish_submission(df: DataFrame, key: str, predictions, test: DataFrame, folder: str, stamp: str, strategy=None, seed=None) -> str:
    """Write aside, validate what was written, rename into place: readers of ``folder`` see a whole valid submission or none.

    The table is written below ``folder`` in a folder whose name Spark's readers skip, read back from there as text and validated; one with errors is
    deleted and raises, as does a name that is already published. ``df`` is computed once. Returns the published path.
    """
    spark, name = df.sparkSession, submission_name(stamp, strategy, seed)
    place, outer = f"{folder}/{name}", f"{folder}/_aside-{uuid.uuid4().hex}"
    fs, path = file_system(spark, folder)
    if fs.exists(path(place)):
        raise FileExistsError(place)
    formatted = project_required(df, [key, *predictions], predictions)
    try:
        aside = write_csv(formatted, f"{outer}/{name}")
        report = validate_submission(read_csv(spark, aside, formatted.schema), key, predictions, test).first()
        if not report["is_valid"]:
            raise ValueError("invalid submission: " + "; ".join(report["errors"]))
        if not fs.rename(path(aside), path(place)):
            raise OSError(f"cannot rename {aside} to {place}")
    finally:
        fs.delete(path(outer), True)
    return place


def grade_submissions(subs: DataFrame, answers: DataFrame, key: str, metric: str, thresholds: DataFrame) -> DataFrame:
    """One row per competition of ``subs`` (competition, key, p): counts, score by ``metric``, reason, medal.

    Each submission is held against all answers (key, y). Only a whole one is graded: with missing, extra or repeated ids or with
    null or NaN predictions the score is null, the medal 'none', and ``reason`` names the first fault.
    """
    names = subs.select("competition").distinct()
    given = names.agg(F.collect_set("competition")).scalar()  # the submissions graded at once: a handful of names
    wanted = answers.select(key, "y", F.explode(given).alias("competition"))
    per = subs.groupBy("competition", key).agg(F.max("p").alias("p"), F.count("*").alias("copies"), F.count_if(metrics.absent(F.col("p"))).alias("absent"))
    joined = per.withColumn("s", F.lit(True)).join(wanted.withColumn("a", F.lit(True)), ["competition", key], "full")
    joined = written(joined.select("competition", key, "y", "p", "copies", "absent", "s", "a"), "graded")
    c = F.col
    counts = joined.groupBy("competition").agg(
        F.count_if(c("s") & c("a")).alias("matched"), F.count_if(c("s").isNull()).alias("missing"), F.count_if(c("a").isNull()).alias("extra"),
        F.count_if(c("copies") > 1).alias("repeated"), F.count_if(c("absent") > 0).alias("unscored"),
    )
    reason = F.when(c("missing") > 0, "missing ids").when(c("extra") > 0, "unknown ids").when(c("repeated") > 0, "repeated ids").when(c("unscored") > 0, "missing predictions")
    scores = metrics.score_by(joined, c("competition"), metric, "y", "p").withColumnRenamed("name", "competition")
    judged = counts.withColumn("reason", reason).join(scores, "competition", "left").withColumn("score", F.when(c("reason").isNull(), c("score")))
    return lk.medal_band(judged, thresholds)


def grade_submission(sub: DataFrame, answers: DataFrame, key: str, competition: str, thresholds: DataFrame, metric: str = "auc") -> DataFrame:
    """One submission (key, p), see ``grade_submissions``."""
    return grade_submissions(sub.withColumn("competition", F.lit(competition)), answers, key, metric, thresholds)
