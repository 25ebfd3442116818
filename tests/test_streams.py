"""Streams against their batch twins: several portions, rows in any order, hot keys, files that arrive in parts."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import lookups, metrics, runs
from tablewright.streaming import jobs


def portions(rows, n):
    size = -(-len(rows) // n)
    return [rows[i * size:(i + 1) * size] for i in range(n)]


def test_metric_issues_equal_the_batch_job(spark, tmp_path):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 5), i, rng.random(), rng.random(), rng.uniform(0, 100)) for i in range(600)]
    clock = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("step") * 60))
    rng.shuffle(rows)  # rows come late by any time
    schema = "run long, step long, val_score double, train_score double, util double"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i, part in enumerate(portions(rows, 4)):
        clock(spark.createDataFrame(part, schema)).write.mode("append").parquet(source)
        jobs.metric_issues(jobs.file_stream(spark, source, f"{schema}, ts timestamp"), ["run"], "step", "ts", "600 MINUTES", out, check, close=i == 3)
    got = spark.read.parquet(out).select("run", "step", "best_score", "points", "issue")
    want = runs.metric_issues(spark.createDataFrame(rows, schema), ["run"], "step").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_wait_or_are_counted(spark, tmp_path):
    schema = "run long, step long, val_score double, train_score double, util double, ts timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(steps, **options):
        rows = spark.createDataFrame([(0, s, v, v, 90.0) for s, v in steps], "run long, step long, val_score double, train_score double, util double")
        rows.withColumn("ts", F.timestamp_seconds(F.col("step") * 60)).write.mode("append").parquet(source)
        jobs.metric_issues(jobs.file_stream(spark, source, schema), ["run"], "step", "ts", "5 MINUTES", out, check, **options)

    arrive([(2, 0.2), (3, 0.3)])
    arrive([(1, 0.9)])  # late by two minutes: it waits with the others
    arrive([(20, 0.5)])
    arrive([(4, 1.0), (21, 0.6)], close=True)  # step 4 is late by sixteen minutes
    got = {r["step"]: (r["best_score"], r["points"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (0.9, 1), 2: (0.9, 2), 3: (0.9, 3), 20: (0.9, 4), 21: (0.9, 5)}
    assert [r["step"] for r in spark.read.parquet(f"{out}_late").collect()] == [4]
    arrive([(9000, 0.1)], keep="1 HOUR", close=True)
    state = jobs.latest_batch(spark, f"{out}_state").collect()
    assert [(r["run"], r["_points"]) for r in state] == [(0, 6)]


def test_submission_in_two_files_is_graded_whole(spark, tmp_path):
    root, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    answers = spark.createDataFrame([("c", i, i % 2) for i in range(8)], "competition string, id long, y int")
    limits = lookups.threshold_table(spark, {"c": (0.5, 0.7, 0.9, False)})
    seen = []
    halves = [[(0, 0.1), (1, 0.2), (2, 0.9), (3, 0.3)], [(4, 0.2), (5, 0.8), (6, 0.4), (7, 0.9)]]
    for half in halves:
        df = spark.createDataFrame(half, "id long, p double").coalesce(1)
        df.write.mode("append").option("header", "true").csv(f"{root}/c/seed_3")
        stream = jobs.file_stream(spark, root, "id long, p double", "csv", header="true")
        jobs.grade_arrivals(stream, root, "id long, p double", answers, limits, out, check, on_found=lambda g: seen.append(g.count()))
    whole = spark.createDataFrame(halves[0] + halves[1], "id long, p double").join(answers, "id")
    want = metrics.auc(whole, "y", ["p"]).first()["auc"]
    got = jobs.latest_grades(spark, out).collect()
    assert [(r["competition"], r["seed"], r["medal"], r["reason"]) for r in got] == [("c", 3, "bronze", None)]
    assert got[0]["score"] == pytest.approx(want) and seen == [1, 1]
    first = spark.read.parquet(out).where("batch = 0").first()
    assert (first["score"], first["medal"], first["reason"]) == (None, "none", "missing ids")


def test_timeouts_by_hand(spark, tmp_path):
    schema = "run long, kind string, ts timestamp"
    rows = [
        (1, "start", "2024-01-01 00:00:00"), (1, "submission", "2024-01-01 03:59:00"), (2, "start", "2024-01-01 00:00:00"),
        (2, "submission", "2024-01-01 04:01:00"), (3, "start", "2024-01-01 01:00:00"), (-1, "end", "2025-01-01 00:00:00"),
    ]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (rows[:3], rows[3:]):
        df = spark.createDataFrame(part, "run long, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(source)
        jobs.append_files(jobs.arrival_timeouts(jobs.file_stream(spark, source, schema), "4 hours"), out, check)
    got = {r["run"]: (r["status"], str(r["at"])) for r in spark.read.parquet(out).collect()}
    # run 3 starts before the last row of the first portion: the watermark delay keeps it
    assert got == {1: ("arrived", "2024-01-01 03:59:00"), 2: ("timeout", "2024-01-01 04:00:00"), 3: ("timeout", "2024-01-01 05:00:00")}


def test_windowed_profile_closes_windows(spark, tmp_path):
    schema = "ts timestamp, v double"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in ([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", None)], [("2024-01-01 05:00:00", None)], [("2024-01-01 09:00:00", 2.0)]):
        df = spark.createDataFrame(part, "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(source)
        jobs.profile(jobs.file_stream(spark, source, schema), ["v"], out, check, window="1 hour", time="ts", delay="1 hour")
    got = sorted((str(r["start"]), r["rows"], r["null_v"]) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01 00:00:00", 2, 1), ("2024-01-01 05:00:00", 1, 1)]


def test_running_report_and_trace(spark, tmp_path):
    schema = "competition string, has_submission boolean, medal string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in ([("a", True, "gold"), ("a", False, "none")], [("a", True, "bronze"), ("b", True, "none")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        jobs.medal_report(jobs.file_stream(spark, source, schema), out, check)
    got = {r["competition"]: (r["total_runs"], r["submissions"], r["total_medals"]) for r in jobs.latest_batch(spark, out).collect()}
    assert got == {"a": (3, 2, 2), "b": (1, 1, 0)}


def test_only_touched_totals_are_rewritten(spark, tmp_path):
    """A batch with one key rewrites that key's part alone; what no batch reads again is gone; totals go on over parts of several ages."""
    schema = "run long, step long, val_score double, train_score double, util double, ts timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(runs_, at):
        rows = spark.createDataFrame([(r, at + i, 0.5, 0.5, 90.0) for i, r in enumerate(runs_)], "run long, step long, val_score double, train_score double, util double")
        rows.withColumn("ts", F.timestamp_seconds(F.col("step") * 60)).write.mode("append").parquet(source)
        jobs.metric_issues(jobs.file_stream(spark, source, schema), ["run"], "step", "ts", "0 MINUTES", out, check)

    arrive(list(range(40)), 0)
    arrive([3], 100)
    arrive([3, 9], 200)
    arrive([9], 300)
    versions = jobs.state_versions(spark, f"{out}_state", 99)
    assert sorted(found for found in versions.values() if found != [0]) == [[2], [3, 2]]  # run 3's part, and run 9's with the one a repeated batch would read
    got = {(r.run, r.step): r.points for r in spark.read.parquet(out).where("step >= 100").collect()}
    assert got == {(3, 100): 2, (3, 200): 3, (9, 201): 2, (9, 300): 3}
    for name in ("held", "mark"):
        assert sorted(p.name for p in tmp_path.glob(f"out_{name}/batch=*")) == ["batch=2", "batch=3"]
