"""Queries: streaming jobs, each run over files that arrive in two portions."""

from pyspark.sql import functions as F

from tablewright.operators import lookups as lk
from tablewright.plans.grading import AUC_SQL
from tablewright.plans.lookups import MEDAL_SQL, SEED_SQL
from tablewright.plans.ordering import ISSUE_SQL, RETRY_SQL, errors
from tablewright.plans.registry import query
from tablewright.plans.statistics import REPORT_SQL, banded_runs, rounded
from tablewright.session import scratch
from tablewright.sources import writers
from tablewright.streaming import jobs

HALF = "ts < timestamp_ntz '2024-01-16'"


def in_two_portions(t, df, early, run, name):
    """Writes the rows of the SQL condition ``early`` and runs the job, then the rest and runs it again; gives the output."""
    base = scratch(t.spark, name)
    source, out, check = f"{base}/in", f"{base}/out", f"{base}/check"
    for i, part in enumerate([early, f"not ({early})"]):
        df.where(part).write.parquet(f"{source}/portion{i}")
        run(jobs.file_stream(t.spark, source, df.schema), out, check)
    return out


CUTS = ["2024-01-09", "2024-01-17", "2024-01-25"]
LATENESS = "4 DAYS"


def arrival(ts, key):
    """SQL: the portion of a row that arrives 0 to 3 days after its time, by its key."""
    return " + ".join(f"CAST({ts} + {key} % 4 * INTERVAL '1' DAY >= timestamp_ntz '{cut}' AS INT)" for cut in CUTS)


def in_late_portions(t, df, key, run, name):
    """Four arrivals whose rows come up to three days late, after younger ones. The last run closes the stream."""
    base = scratch(t.spark, name)
    source, out, check = f"{base}/in", f"{base}/out", f"{base}/check"
    for i in range(len(CUTS) + 1):
        df.where(f"{arrival('ts', key)} = {i}").write.parquet(f"{source}/portion{i}")
        run(jobs.file_stream(t.spark, source, df.schema), out, check, i == len(CUTS))
    return out


LANG_THRESHOLDS = {"en": (0.4, 0.5, 0.9, False), "fr": (0.3, 0.6, 0.9, False), "de": (0.5, 0.6, 0.7, False)}
LANG_SQL = "(VALUES " + ", ".join(
    f"('{k}', {a}::double, {b}::double, {c}::double, {str(low).lower()})" for k, (a, b, c, low) in LANG_THRESHOLDS.items()
) + ") AS th(competition, bronze, silver, gold, lower_is_better)"


GRADE_SQL = f"""WITH s AS (SELECT d.doc_id AS id, d.lang AS competition, y, p AS s0, words AS s1 FROM pred JOIN documents d ON d.doc_id = pred.id),
    l AS (SELECT competition, 0 AS seed, y, s0 AS v FROM s UNION ALL SELECT competition, 1, y, s1 FROM s),
    r AS (SELECT *, rank() OVER (PARTITION BY competition, seed ORDER BY v) + (count(*) OVER (PARTITION BY competition, seed, v) - 1) / 2.0::double AS r FROM l),
    a AS (SELECT competition, seed, {AUC_SQL} AS score FROM r GROUP BY 1, 2)
    SELECT a.competition, seed, round(score, 9) AS score, bronze IS NOT NULL AS has_threshold, {MEDAL_SQL} AS medal,
      round(score - bronze, 9) AS margin, NULL::varchar AS reason FROM a LEFT JOIN {LANG_SQL} ON a.competition = th.competition"""


def graded_arrivals(t):
    """Runs the job once per seed; gives the folder that holds its output and what the callback has written."""
    base = scratch(t.spark, "submissions")
    root = f"{base}/in"
    scored = t.pred.join(t.documents.select(F.col("doc_id").alias("id"), "lang"), "id")
    thresholds = lk.threshold_table(t.spark, LANG_THRESHOLDS)
    answers = t.pred.join(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("competition")), "id").select("competition", "id", "y")
    for seed, score in enumerate(["p", "words"]):
        # one folder per competition, one arrival per seed
        for lang in ("en", "fr", "de", "es"):
            one = scored.where(F.col("lang") == lang).select("id", F.col(score).alias("p"))
            writers.write_csv(one, f"{root}/{lang}/seed_{seed}")
        stream = jobs.file_stream(t.spark, root, "id long, p double", "csv", header="true")
        jobs.grade_arrivals(stream, root, "id long, p double", answers, thresholds, f"{base}/out", f"{base}/check",
                            on_found=lambda found: found.write.mode("append").parquet(f"{base}/found"))
    return base


@query("stream_grade", GRADE_SQL, ("pred",))
def stream_grade(t):
    return rounded(jobs.latest_grades(t.spark, f"{graded_arrivals(t)}/out"), "score", "margin")


@query("stream_callback", GRADE_SQL, ("pred",))
def stream_callback(t):
    """What the user's function was given, batch by batch."""
    return rounded(t.spark.read.parquet(f"{graded_arrivals(t)}/found"), "score", "margin")


@query("stream_medal_report", f"""WITH {SEED_SQL}, {REPORT_SQL} SELECT competition, total_runs, submissions, gold, silver, bronze,
    total_medals, round(any_medal_percent, 9) AS any_medal_percent FROM report""", ("runs",))
def stream_medal_report(t):
    df = banded_runs(t).select("competition", "has_submission", "medal")
    out = in_two_portions(t, df, "medal = 'none'", jobs.medal_report, "medal_report")
    return rounded(jobs.latest_batch(t.spark, out), "any_medal_percent")


TIMEOUT_SQL = """WITH s AS (SELECT user_id AS run, min(ts) AS start FROM events GROUP BY 1),
    a AS (SELECT s.run, start, min(ts) FILTER (WHERE event_type = 'purchase') AS first FROM s JOIN events e ON e.user_id = s.run GROUP BY 1, 2)
    SELECT run, CASE WHEN first <= start + INTERVAL 10 HOUR THEN 'arrived' ELSE 'timeout' END AS status,
      strftime(CASE WHEN first <= start + INTERVAL 10 HOUR THEN first ELSE start + INTERVAL 10 HOUR END, '%Y-%m-%d %H:%M:%S') AS at FROM a"""


@query("stream_timeout", TIMEOUT_SQL)
def stream_timeout(t):
    c = F.col
    starts = t.events.groupBy(c("user_id").alias("run")).agg(F.min("ts").alias("ts")).withColumn("kind", F.lit("start"))
    found = t.events.where(c("event_type") == "purchase").select(c("user_id").alias("run"), "ts", F.lit("submission").alias("kind"))
    # a row far behind the last event moves the watermark past every open timer
    end = t.events.agg(F.lit(-1).cast("long").alias("run"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit("end").alias("kind"))
    rows = starts.unionByName(found).unionByName(end).withColumn("ts", c("ts").cast("timestamp"))

    def run(stream, out, check):
        jobs.append_files(jobs.arrival_timeouts(stream, "60 days", 10), out, check)

    # later rows first; the end comes last
    out = in_two_portions(t, rows, "ts >= timestamp '2024-01-16' and run >= 0", run, "timeouts")
    return t.spark.read.parquet(out).select("run", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("stream_metric_issues", ISSUE_SQL, ("runs",))
def stream_metric_issues(t):
    def run(stream, out, check, last):
        jobs.metric_issues(stream, ["run"], "step", "ts", LATENESS, out, check, close=last)

    out = in_late_portions(t, t.runs, "step", run, "issues")
    return t.spark.read.parquet(out).select("run", "step", "issue")


@query("stream_retries", RETRY_SQL, ("logs",))
def stream_retries(t):
    df = errors(t).join(t.logs.select("id", "ts"), "id")

    def run(stream, out, check, last):
        jobs.retries(stream, ["session", "error_class"], "id", "ts", LATENESS, out, check, close=last)

    out = in_late_portions(t, df, "id", run, "retries")
    return t.spark.read.parquet(out).select("id", "session", "error_class", "attempt", "fallback")


LATE_SQL = f"""WITH a AS (SELECT run, step, ts, {arrival('ts', 'step').replace('timestamp_ntz', 'TIMESTAMP')} AS portion FROM runs),
    m AS (SELECT portion, max(max(ts)) OVER (ORDER BY portion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM a GROUP BY 1),
    l AS (SELECT run, step, coalesce(ts <= mark, false) AS late FROM a JOIN m USING (portion))
    SELECT run, step, late, CASE WHEN NOT late THEN count(*) FILTER (WHERE NOT late) OVER (PARTITION BY run ORDER BY step) END AS points FROM l"""


@query("stream_late_rows", LATE_SQL, ("runs",))
def stream_late_rows(t):
    """A delay of one day over rows that come up to three days late: those the watermark has passed are kept apart, the others counted on from batch to batch."""

    def run(stream, out, check, last):
        jobs.metric_issues(stream, ["run"], "step", "ts", "1 DAY", out, check, close=last)

    out = in_late_portions(t, t.runs, "step", run, "late")
    seen = t.spark.read.parquet(out).select("run", "step", F.lit(False).alias("late"), "points")
    return seen.unionByName(t.spark.read.parquet(f"{out}_late").select("run", "step", F.lit(True).alias("late"), F.lit(None).cast("long").alias("points")))


@query("stream_alerts", """SELECT run, step, CASE WHEN util / 100 >= 0.90::double THEN 'GPU_OOM_PREVENTION'
    WHEN val_score >= 0.90::double THEN 'RAM_CLEANUP' WHEN train_score >= 0.80::double THEN 'TIMEOUT_APPROACHING' END AS alert FROM runs""", ("runs",))
def stream_alerts(t):
    def run(stream, out, check):
        c = F.col
        jobs.append_files(jobs.alerts(stream, c("util") / 100, c("val_score"), c("train_score")).select("run", "step", "alert"), out, check)

    return t.spark.read.parquet(in_two_portions(t, t.runs, HALF, run, "alerts"))


@query("stream_trace", "SELECT 'action' AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, id, session FROM logs", ("logs",))
def stream_trace(t):
    def run(stream, out, check):
        entries = writers.trace_entries(stream, "action", F.col("ts"), id=F.col("id"), session=F.col("session"))
        jobs.append_files(entries, out, check, "json")

    out = in_two_portions(t, t.logs, HALF, run, "trace")
    body = F.from_json("payload", "id long, session long")
    got = t.spark.read.schema("type string, timestamp string, payload string").json(out)
    return got.select("type", "timestamp", body.alias("b")).select("type", "timestamp", "b.*")


@query("stream_profile", """SELECT count(*) AS rows, count(*) - count(price) AS null_price, count(*) - count(priority) AS null_priority FROM tab""", ("tab",))
def stream_profile(t):
    out = in_two_portions(t, t.tab, "is_train", lambda s, o, k: jobs.profile(s, ["price", "priority"], o, k), "profile")
    return jobs.latest_batch(t.spark, out)


@query("stream_class_counts", "SELECT priority AS value, count(*) AS n FROM tab WHERE priority IS NOT NULL GROUP BY 1", ("tab",))
def stream_class_counts(t):
    out = in_two_portions(t, t.tab, "is_train", lambda s, o, k: jobs.class_counts(s, "priority", o, k), "classes")
    return jobs.latest_batch(t.spark, out)


@query("stream_window_profile", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS rows, count(*) - count(score) AS null_score
    FROM (SELECT ts, CASE WHEN event_id % 5 > 0 THEN value END AS score FROM events) GROUP BY 1""")
def stream_window_profile(t):
    """Rows and nulls per hour of rows that come up to three days late; an hour is written once, when the watermark has passed it."""
    c = F.col
    rows = t.events.select("event_id", "ts", F.when(c("event_id") % 5 > 0, c("value")).alias("score"))
    # a row far behind the last event moves the watermark past every hour; its own hour stays open
    end = rows.agg(F.lit(None).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(None).cast("double").alias("score"))
    every = rows.unionByName(end.withColumn("event_id", F.lit(0).cast("long")))

    def run(stream, out, check, last):
        timed = stream.withColumn("ts", c("ts").cast("timestamp"))
        jobs.profile(timed, ["score"], out, check, window="1 hour", time="ts", delay="4 days")

    out = in_late_portions(t, every, "event_id", run, "hours")
    return t.spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows", "null_score")
