"""Queries: aggregates and run reports."""

from pyspark.sql import functions as F

from tablewright.operators import lookups as lk
from tablewright.operators import ordered
from tablewright.operators import profiling as pf
from tablewright.operators import statistics as st
from tablewright.plans.columns import ragged, ragged_metrics
from tablewright.plans.lookups import EVENT_THRESHOLDS, GRID_SQL, MARGIN_SQL, MEDAL_SQL, SEED_SQL, THRESHOLD_SQL, grid, seed_runs
from tablewright.plans.registry import query


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("distinct_labels", "SELECT count(DISTINCT priority) AS distinct_values FROM tab", ("tab",))
def distinct_labels(t):
    return pf.distinct_count(t.tab, "priority")


@query("class_weights", """SELECT count(*) FILTER (WHERE toxic = 1) AS positives, count(*) FILTER (WHERE toxic = 0) AS negatives,
    count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1) AS pos_weight FROM labelled""", ("labelled",))
def class_weights(t):
    return st.class_weights(t.labelled, "toxic")


LENGTH_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(stddev_samp(length({c})), 6) AS sd, round(avg(length({c})), 6) AS mean,
      (SELECT length({c}) FROM names WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
      max(length({c})) AS longest FROM names""" for c in ("code", "seg", "seg_null"))


@query("string_length_stats", f"""SELECT "column", n, sd, mean, CAST(mode AS INTEGER) AS mode, CAST(longest AS INTEGER) AS longest
    FROM ({LENGTH_SQL})""", ("names",))
def string_length_stats(t):
    return rounded(st.string_length_stats(t.names, ["code", "seg", "seg_null"]), "sd", "mean", digits=6)


@query("quantiles_exact", " UNION ALL ".join(
    f"SELECT '{c}' AS name, {q}::double AS q, round(quantile_cont({c}, {q}), 6) AS quantile FROM items"
    for c in ("quantity", "price", "discount") for q in (0.15, 0.5, 0.85)), ("items",))
def quantiles_exact(t):
    return rounded(ordered.exact_quantiles(t.items, ["quantity", "price", "discount"], [0.15, 0.5, 0.85]), "quantile", digits=6)


@query("most_frequent", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT {c} FROM tab WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS value"""
    for c in ("priority", "status")), ("tab",))
def most_frequent(t):
    return st.most_frequent(t.tab, ["priority", "status"])


@query("mean_sem", """SELECT run, count(val_score) AS n, round(avg(val_score), 9) AS mean,
    round(CASE WHEN count(val_score) < 2 THEN 0 ELSE stddev_samp(val_score) / sqrt(count(val_score)) END, 9) AS sem FROM runs GROUP BY 1""", ("runs",))
def mean_sem(t):
    return rounded(st.mean_sem(t.runs, ["run"], "val_score"), "mean", "sem")


@query("metric_stats", """WITH m AS (SELECT 'val_score' AS metric, val_score AS v FROM runs WHERE success
      UNION ALL SELECT 'train_score', train_score FROM runs WHERE success AND event_type = 'click'
      UNION ALL SELECT 'util', util FROM runs WHERE success AND event_type = 'view')
    SELECT metric, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v) / sqrt(count(*)), 9) AS std_error FROM m GROUP BY 1""", ("runs",))
def metric_stats(t):
    return rounded(st.metric_stats(ragged_metrics(t), "metrics", "success"), "mean", "std_error")


def graded_grid(t):
    banded = lk.medal_band(grid(t), lk.threshold_table(t.spark, EVENT_THRESHOLDS))
    return banded.withColumn("is_medal", F.col("medal") != "none")


@query("medal_rollup", f"""WITH {SEED_SQL}, {GRID_SQL}, g AS (SELECT gr.competition, found, {MEDAL_SQL} <> 'none' AS is_medal
      FROM grid gr LEFT JOIN {THRESHOLD_SQL} ON gr.competition = th.competition),
    f AS (SELECT competition, found, coalesce(is_medal, false) AS is_medal, CASE WHEN is_medal THEN 100.0::double ELSE 0.0::double END AS flag FROM g)
    SELECT CASE WHEN grouping(competition) = 1 THEN 'ALL' ELSE competition END AS competition, count(*) AS runs,
      count(*) FILTER (WHERE found) AS submissions, count(*) FILTER (WHERE is_medal) AS medals,
      round(100.0::double * count(*) FILTER (WHERE is_medal) / count(*), 9) AS medal_rate, round(avg(flag), 9) AS mean_any_medal,
      round(stddev_samp(flag) / sqrt(count(*)), 9) AS std_error FROM f GROUP BY ROLLUP (competition)""", ("runs",))
def medal_rollup(t):
    return rounded(st.medal_rollup(graded_grid(t)), "medal_rate", "mean_any_medal", "std_error")


def banded_runs(t):
    runs = seed_runs(t).select("competition", "seed", "score", "has_submission")
    banded = lk.medal_band(runs, lk.threshold_table(t.spark, EVENT_THRESHOLDS))
    return banded.withColumn("medal", F.when(F.col("has_submission"), F.col("medal")).otherwise("none"))


REPORT_SQL = f"""report AS (SELECT competition, count(*) AS total_runs, count(*) FILTER (WHERE has_submission) AS submissions,
    count(*) FILTER (WHERE medal = 'gold') AS gold, count(*) FILTER (WHERE medal = 'silver') AS silver,
    count(*) FILTER (WHERE medal = 'bronze') AS bronze, count(*) FILTER (WHERE medal <> 'none') AS total_medals,
    100.0::double * count(*) FILTER (WHERE medal <> 'none') / count(*) AS any_medal_percent
    FROM (SELECT s.competition, has_submission, CASE WHEN has_submission THEN {MEDAL_SQL} ELSE 'none' END AS medal
      FROM seeds s LEFT JOIN {THRESHOLD_SQL} ON s.competition = th.competition) GROUP BY 1)"""


@query("medal_report", f"""WITH {SEED_SQL}, {REPORT_SQL} SELECT competition, total_runs, submissions, gold, silver, bronze,
    total_medals, round(any_medal_percent, 9) AS any_medal_percent FROM report""", ("runs",))
def medal_report(t):
    return rounded(st.medal_report(banded_runs(t)), "any_medal_percent")


@query("run_summary", f"""WITH {SEED_SQL} SELECT CASE WHEN grouping(competition) = 1 THEN 'ALL' ELSE competition END AS competition,
    count(*) AS total, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE has_submission) AS with_submission,
    round(100.0::double * count(*) FILTER (WHERE success) / count(*), 9) AS success_percent,
    round(100.0::double * count(*) FILTER (WHERE has_submission) / count(*), 9) AS submission_percent,
    round(sum(runtime_seconds) / 3600.0::double, 9) AS hours FROM seeds GROUP BY ROLLUP (competition)""", ("runs",))
def run_summary(t):
    return rounded(st.run_summary(seed_runs(t)), "success_percent", "submission_percent", "hours")


@query("combined_rate", f"""WITH {SEED_SQL}, {REPORT_SQL} SELECT CAST(sum(total_medals) AS BIGINT) AS medals,
    CAST(sum(total_runs) AS BIGINT) AS runs, round(100.0::double * sum(total_medals) / sum(total_runs), 9) AS any_medal_percent FROM report""", ("runs",))
def combined_rate(t):
    return rounded(st.combined_rate(st.medal_report(banded_runs(t))), "any_medal_percent")


@query("compute_metrics", f"""WITH {SEED_SQL} SELECT competition, round(avg(runtime_seconds), 6) AS avg_runtime_seconds,
    round(avg(runtime_seconds) / 3600.0::double, 6) AS avg_runtime_hours,
    round(avg(score) / (avg(runtime_seconds) / 3600.0::double), 6) AS resource_efficiency FROM seeds WHERE success GROUP BY 1""", ("runs",))
def compute_metrics(t):
    return rounded(st.compute_metrics(seed_runs(t), ["competition"]), "avg_runtime_seconds", "avg_runtime_hours", "resource_efficiency", digits=6)


@query("evaluation_report", f"""WITH {SEED_SQL}, r AS (SELECT competition, count(*) AS num_seeds, count(*) FILTER (WHERE success) AS successful_runs,
      count(*) FILTER (WHERE NOT success) AS failed_runs, sum(runtime_seconds) AS total_runtime_seconds,
      coalesce(avg(score) FILTER (WHERE success), 0) AS score,
      coalesce(stddev_samp(score) FILTER (WHERE success) / sqrt(count(*) FILTER (WHERE success)), 0) AS std_error,
      avg(runtime_seconds) FILTER (WHERE success) AS avg_runtime_seconds FROM seeds GROUP BY 1)
    SELECT r.competition, num_seeds, successful_runs, failed_runs, total_runtime_seconds, round(score, 6) AS mean_score,
      round(std_error, 6) AS std_error, round(avg_runtime_seconds, 6) AS avg_runtime_seconds, bronze IS NOT NULL AS has_threshold,
      coalesce(CASE WHEN lower_is_better THEN score <= bronze ELSE score >= bronze END, false) AS achieved_medal,
      round({MARGIN_SQL}, 6) AS margin FROM r LEFT JOIN {THRESHOLD_SQL} ON r.competition = th.competition""", ("runs",))
def evaluation_report(t):
    df = st.evaluation_report(seed_runs(t), lk.threshold_table(t.spark, EVENT_THRESHOLDS))
    return rounded(df, "mean_score", "std_error", "avg_runtime_seconds", "margin", digits=6)


@query("nested_report", f"""WITH {SEED_SQL} SELECT competition, seed, count(*) FILTER (WHERE success) AS runs, round(coalesce(avg(score) FILTER (WHERE success), 0), 6) AS mean,
    round(coalesce(stddev_samp(score) FILTER (WHERE success) / sqrt(count(*) FILTER (WHERE success)), 0), 6) AS std_error,
    CAST(sum(count(*)) OVER (PARTITION BY competition) AS BIGINT) AS num_seeds FROM seeds GROUP BY 1, 2""", ("runs",))
def nested_report(t):
    report = st.nested_report(seed_runs(t), lk.threshold_table(t.spark, EVENT_THRESHOLDS))
    return rounded(report.select("competition", "num_seeds", F.inline("results")), "mean", "std_error", digits=6)


@query("full_report", f"""WITH {SEED_SQL}, f AS (SELECT competition, seed, arg_min(score, step) AS score, arg_min(success, step) AS success,
      arg_min(runtime_seconds, step) AS runtime, arg_min(has_submission, step) AS has_submission FROM seeds GROUP BY 1, 2),
    b AS (SELECT f.*, CASE WHEN has_submission THEN {MEDAL_SQL} ELSE 'none' END AS medal FROM f LEFT JOIN {THRESHOLD_SQL} ON f.competition = th.competition),
    k AS (SELECT competition, count(*) AS total_runs, count(*) FILTER (WHERE medal <> 'none') AS total_medals FROM b GROUP BY 1),
    m AS (SELECT event_type AS competition, 'val_score' AS metric, val_score AS v FROM runs WHERE success
      UNION ALL SELECT event_type, 'train_score', train_score FROM runs WHERE success AND event_type = 'click'
      UNION ALL SELECT event_type, 'util', util FROM runs WHERE success AND event_type = 'view'),
    u AS (SELECT competition, 'metric' AS part, metric AS name, count(v) AS n, avg(v) AS value, coalesce(stddev_samp(v) / sqrt(count(v)), 0) AS other, NULL AS medal
        FROM m WHERE v IS NOT NULL GROUP BY competition, metric
      UNION ALL SELECT competition, 'result', CAST(seed AS VARCHAR), CAST(has_submission AS BIGINT), score, NULL, medal FROM b
      UNION ALL SELECT competition, 'run', CAST(seed AS VARCHAR), CAST(success AS BIGINT), score, runtime, NULL FROM b)
    SELECT competition, total_runs, total_medals, part, name, n, round(value, 6) AS value, round(other, 6) AS other, medal FROM k JOIN u USING (competition)""", ("runs",))
def full_report(t):
    """The three nested lists of every competition's report, opened."""
    c = F.col
    runs = t.runs.select(
        c("event_type").alias("competition"), (c("run") % 3).alias("seed"), "step", c("val_score").alias("score"), "success",
        (c("util") * 60.0).alias("runtime_seconds"), (c("val_score") > 0.02).alias("has_submission"), ragged().alias("metrics"),
    )
    report = st.full_report(runs, lk.threshold_table(t.spark, EVENT_THRESHOLDS))

    def opened(items, part, name, n, value, other, medal):
        def one(x):
            cells = [F.lit(part).alias("part"), x[name].cast("string").alias("name"), x[n].cast("long").alias("n"), x[value].alias("value")]
            rest = [(x[other] if other else F.lit(None).cast("double")).alias("other"), (x[medal] if medal else F.lit(None).cast("string")).alias("medal")]
            return F.struct(*cells, *rest)

        return F.transform(items, one)

    lists = F.concat(
        opened("metrics", "metric", "metric", "n", "mean", "std_error", None),
        opened("results", "result", "seed", "has_submission", "score", None, "medal"),
        opened("runs", "run", "seed", "success", "score", "runtime_seconds", None),
    )
    return rounded(report.select("competition", "total_runs", "total_medals", F.inline(lists)), "value", "other", digits=6)


@query("duplicate_ids", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM sub GROUP BY id)", ("sub",))
def duplicate_ids(t):
    return st.duplicate_ids(t.sub, "id")
