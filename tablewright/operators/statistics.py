"""Aggregates: string lengths, modes, means with standard errors, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.lookups import medal_band


def string_length_stats(df: DataFrame, cols) -> DataFrame:
    """(column, n, sd, mean, mode, longest) of string lengths; the smallest of equally common lengths is the mode."""
    long = df.select(*cols).unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", F.length("value").alias("len")).agg(F.count("*").alias("n"))
    # from here on one row per column and length
    s = counts.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("len")).alias("s1"),
        F.sum(F.col("n") * F.col("len") * F.col("len")).alias("s2"),
        F.min_by("len", F.struct(-F.col("n"), F.col("len"))).alias("mode"),
        F.max("len").alias("longest"),
    )
    mean = F.col("s1") / F.col("n")
    var = F.try_divide(F.col("s2") - F.col("s1") * mean, F.col("n") - 1)
    return s.select("column", "n", F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), mean.alias("mean"), "mode", "longest")


def most_frequent(df: DataFrame, cols) -> DataFrame:
    """(column, value): the most common non-null value, the smallest on ties."""
    long = df.select(*cols).unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def sem(x) -> Column:
    """Standard error of the mean; 0 below two values."""
    return F.coalesce(F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double"))), F.lit(0.0))


def mean_or_zero(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def mean_sem(df: DataFrame, by, x) -> DataFrame:
    return df.groupBy(*by).agg(F.count(x).alias("n"), mean_or_zero(x).alias("mean"), sem(x).alias("sem"))


def metric_stats(runs: DataFrame, metrics: str, success: str) -> DataFrame:
    """(metric, n, mean, std_error) over successful runs; a run counts only for metrics it has."""
    long = runs.where(F.col(success)).select(F.explode(metrics).alias("metric", "v")).where(F.col("v").isNotNull())
    return mean_sem(long, ["metric"], "v").withColumnRenamed("sem", "std_error")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(positives, negatives, pos_weight) of a 0/1 label."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    ).withColumn("pos_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def medal_rollup(grid: DataFrame) -> DataFrame:
    """Per competition and overall (competition 'ALL'): runs, submissions, medals, rate, mean and SEM of 0/100 flags."""
    flag = F.when(F.col("is_medal"), 100.0).otherwise(0.0)
    return grid.withColumn("flag", flag).rollup("competition").agg(
        F.grouping("competition").alias("g"),
        F.count("*").alias("runs"), F.count_if("found").alias("submissions"), F.count_if("is_medal").alias("medals"),
        (100.0 * F.count_if("is_medal") / F.count("*")).alias("medal_rate"),
        mean_or_zero("flag").alias("mean_any_medal"), sem("flag").alias("std_error"),
    ).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("competition")).alias("competition"),
        "runs", "submissions", "medals", "medal_rate", "mean_any_medal", "std_error",
    )


def medal_counts() -> list[Column]:
    """Report aggregates over rows with has_submission and medal."""
    return [
        F.count("*").alias("total_runs"), F.count_if("has_submission").alias("submissions"),
        *[F.count_if(F.col("medal") == m).alias(m) for m in ("gold", "silver", "bronze")],
        F.count_if(F.col("medal") != "none").alias("total_medals"),
        (100.0 * F.count_if(F.col("medal") != "none") / F.count("*")).alias("any_medal_percent"),
    ]


def medal_report(results: DataFrame) -> DataFrame:
    return results.groupBy("competition").agg(*medal_counts())


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals per competition and overall: success and submission shares, hours."""
    return runs.rollup("competition").agg(
        F.grouping("competition").alias("g"), F.count("*").alias("total"),
        F.count_if("success").alias("successful"), F.count_if("has_submission").alias("with_submission"),
        (100.0 * F.count_if("success") / F.count("*")).alias("success_percent"),
        (100.0 * F.count_if("has_submission") / F.count("*")).alias("submission_percent"),
        (F.sum("runtime_seconds") / 3600.0).alias("hours"),
    ).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("competition")).alias("competition"),
        "total", "successful", "with_submission", "success_percent", "submission_percent", "hours",
    )


def combined_rate(reports: DataFrame) -> DataFrame:
    """Total medals over total runs of several reports."""
    return reports.agg(
        F.sum("total_medals").alias("medals"), F.sum("total_runs").alias("runs"),
        F.coalesce(F.try_divide(100.0 * F.sum("total_medals"), F.sum("total_runs")), F.lit(0.0)).alias("any_medal_percent"),
    )


def compute_metrics(runs: DataFrame, by) -> DataFrame:
    """Average runtime and score per hour over successful runs."""
    hours = F.avg("runtime_seconds") / 3600.0
    return runs.where("success").groupBy(*by).agg(
        F.avg("runtime_seconds").alias("avg_runtime_seconds"), hours.alias("avg_runtime_hours"),
        F.coalesce(F.try_divide(mean_or_zero("score"), hours), F.lit(0.0)).alias("resource_efficiency"),
    )


def evaluation_report(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per competition: successes, runtime, mean and error of the score, comparison with the bronze threshold."""
    ok = F.when(F.col("success"), F.col("score"))
    r = runs.groupBy("competition").agg(
        F.count("*").alias("num_seeds"), F.count_if("success").alias("successful_runs"),
        F.count_if(~F.col("success")).alias("failed_runs"), F.sum("runtime_seconds").alias("total_runtime_seconds"),
        mean_or_zero(ok).alias("mean_score"), sem(ok).alias("std_error"),
        F.avg(F.when(F.col("success"), F.col("runtime_seconds"))).alias("avg_runtime_seconds"),
    )
    c = F.col
    better = F.when(c("lower_is_better"), c("mean_score") <= c("bronze")).otherwise(c("mean_score") >= c("bronze"))
    margin = F.when(c("lower_is_better"), c("bronze") - c("mean_score")).otherwise(c("mean_score") - c("bronze"))
    return r.join(thresholds, "competition", "left").select(
        *r.columns, c("bronze").isNotNull().alias("has_threshold"),
        F.coalesce(better, F.lit(False)).alias("achieved_medal"), margin.alias("margin"),
    )


def nested_report(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``evaluation_report`` with ``results``: per seed the successful runs, their mean score and its standard error.

    The list is as long as there are seeds; the runs of a seed are aggregated before they meet.
    """
    ok = F.when(F.col("success"), F.col("score"))
    seeds = runs.groupBy("competition", "seed").agg(F.count_if("success").alias("runs"), mean_or_zero(ok).alias("mean"), sem(ok).alias("std_error"))
    results = seeds.groupBy("competition").agg(F.array_sort(F.collect_list(F.struct("seed", "runs", "mean", "std_error"))).alias("results"))
    return evaluation_report(runs, thresholds).join(results, "competition")


def full_report(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per competition: medal counts and, nested, ``metrics`` (metric, n, mean, std_error), ``results`` (seed, has_submission, score, medal)
    and ``runs`` (seed, success, score, runtime_seconds).

    ``runs`` has competition, seed, step, success, score, runtime_seconds, has_submission and the map ``metrics``. A seed's run is its first by step, so the lists are
    as long as there are seeds or names of metrics; metrics are those of all successful runs. Lists are sorted, and empty where there is nothing.
    """
    parts = ["success", "score", "runtime_seconds", "has_submission"]
    first = runs.groupBy("competition", "seed").agg(F.min_by(F.struct(*parts), "step").alias("run")).select("competition", "seed", "run.*")
    banded = medal_band(first, thresholds).withColumn("medal", F.when(F.col("has_submission"), F.col("medal")).otherwise("none"))

    def listed(*names):
        return F.array_sort(F.collect_list(F.struct(*names)))

    report = banded.groupBy("competition").agg(
        *medal_counts(), listed("seed", "has_submission", "score", "medal").alias("results"), listed("seed", "success", "score", "runtime_seconds").alias("runs"),
    )
    values = runs.where("success").select("competition", F.explode("metrics").alias("metric", "v")).where("v IS NOT NULL")
    stats = mean_sem(values, ["competition", "metric"], "v").withColumnRenamed("sem", "std_error")
    metrics = stats.groupBy("competition").agg(listed("metric", "n", "mean", "std_error").alias("metrics"))
    joined = report.join(metrics, "competition", "left")
    return joined.withColumn("metrics", F.coalesce("metrics", F.array().cast(metrics.schema["metrics"].dataType)))


def acceptable(success, completed, val, train, score: float, gap: float) -> Column:
    """Is a run good enough to stop? Its score reaches ``score`` and its training score is at most ``gap`` higher."""
    return (
        F.when(~success, False).when(completed & val.isNull(), True)
        .when(val < score, False).when((train - val) > gap, False).otherwise(True)
    )
