"""Structured Streaming jobs over file sources.

Every job takes a stream, an output folder and a checkpoint folder, and runs with ``availableNow`` unless another
trigger is given, so the same code serves a long-running watch and a scheduled catch-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablewright import fixed
from tablewright.operators import lookups as lk
from tablewright.operators import metrics, runs
from tablewright.operators import statistics as st
from tablewright.operators.ordered import running
from tablewright.session import file_system, written

AVAILABLE = {"availableNow": True}


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(recursiveFileLookup="true", **options).format(kind).load(path)


def append_files(stream: DataFrame, out: str, checkpoint: str, kind: str = "parquet", trigger=AVAILABLE) -> None:
    """Exactly-once file sink."""
    q = stream.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger)
    q.start(out).awaitTermination()


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger=AVAILABLE) -> None:
    """``fn(batch, batch_id)`` per micro-batch; it must give the same result when a batch is repeated."""
    q = stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(**trigger)
    q.start().awaitTermination()


def write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    """One folder per batch, replaced when the batch is repeated."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def latest_batch(spark: SparkSession, out: str) -> DataFrame:
    """The last complete result that a job wrote."""
    df = spark.read.parquet(out)
    return df.where(F.col("batch") == df.agg(F.max("batch")).scalar()).drop("batch")


# ---- alerts and traces: stateless -------------------------------------------------------------------------
def alerts(stream: DataFrame, accelerator: Column, ram: Column, runtime: Column) -> DataFrame:
    return stream.withColumn("alert", runs.resource_alert(accelerator, ram, runtime))


# ---- grading of arriving submissions ----------------------------------------------------------------------
def arrival_parts(path: Column) -> list[Column]:
    """competition and seed from a path .../<competition>/seed_<n>/<file>"""
    return [
        F.regexp_extract(path, r"([^/]+)/seed_\d+/[^/]+$", 1).alias("competition"),
        F.regexp_extract(path, r"/seed_(\d+)/[^/]+$", 1).cast("int").alias("seed"),
    ]


def grade_arrivals(stream: DataFrame, root: str, schema, answers: DataFrame, thresholds: DataFrame, out: str, checkpoint: str,
                   on_found: Callable[[DataFrame], None] | None = None, trigger=AVAILABLE, metric: str = "auc") -> None:
    """Grades every submission that a batch touched by ``metric``, over all files it has so far.

    A submission of several files may arrive in several batches; the last grade per (competition, seed) counts. ``answers`` are
    (competition, id, y): a submission with missing, unknown or repeated ids or missing predictions has a null score, no medal and
    a reason. The touched submissions stay a table: the files of all are listed and joined with it before they are read further.
    """
    spark = stream.sparkSession
    keyed = stream.select(*arrival_parts(F.col("_metadata.file_path")))

    def grade(batch: DataFrame, batch_id: int) -> None:
        touched = written(batch.distinct(), "touched")
        if touched.isEmpty():
            return
        files = spark.read.schema(schema).options(recursiveFileLookup="true", header="true").csv(root)
        whole = files.select("*", *arrival_parts(F.col("_metadata.file_path"))).join(touched, ["competition", "seed"])
        per = whole.groupBy("competition", "seed", "id").agg(F.max("p").alias("p"), F.count("*").alias("copies"), F.count_if(metrics.absent(F.col("p"))).alias("absent"))
        wanted = answers.join(touched, "competition").withColumn("a", F.lit(True))
        joined = written(per.withColumn("s", F.lit(True)).join(wanted, ["competition", "seed", "id"], "full"), "arrivals")
        run, c = F.concat_ws("/", "competition", "seed").alias("name"), F.col
        counts = joined.groupBy("competition", "seed", run).agg(
            F.count_if(c("s").isNull()).alias("missing"), F.count_if(c("a").isNull()).alias("extra"),
            F.count_if(c("copies") > 1).alias("repeated"), F.count_if(c("absent") > 0).alias("unscored"),
        )
        reason = F.when(c("missing") > 0, "missing ids").when(c("extra") > 0, "unknown ids").when(c("repeated") > 0, "repeated ids").when(c("unscored") > 0, "missing predictions")
        scores = counts.withColumn("reason", reason).join(metrics.score_by(joined, F.concat_ws("/", "competition", "seed"), metric, "y", "p"), "name", "left")
        whole_only = scores.withColumn("score", F.when(c("reason").isNull(), c("score"))).select("competition", "seed", "score", "reason")
        graded = lk.medal_band(whole_only, thresholds)
        write_batch(graded, out, batch_id)
        if on_found:
            on_found(graded)

    each_batch(keyed, grade, checkpoint, trigger=trigger)


def latest_grades(spark: SparkSession, out: str) -> DataFrame:
    df = spark.read.parquet(out)
    value = F.struct(*[c for c in df.columns if c not in ("competition", "seed", "batch")])
    return df.groupBy("competition", "seed").agg(F.max_by(value, "batch").alias("g")).select("competition", "seed", "g.*")


# ---- running reports: streaming aggregates ----------------------------------------------------------------
def medal_report(stream: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE) -> None:
    report = stream.groupBy("competition").agg(*st.medal_counts())
    each_batch(report, lambda df, i: write_batch(df, out, i), checkpoint, "complete", trigger)


def profile(stream: DataFrame, columns, out: str, checkpoint: str, window: str | None = None, time: str | None = None,
            delay: str = "1 hour", trigger=AVAILABLE) -> None:
    """Rows and nulls per column so far; with ``window`` per time window, with state bounded by the watermark."""
    counts = [F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]]
    if window:
        seen = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(*counts)
        each_batch(seen.select("w.start", "rows", *[f"null_{c}" for c in columns]), lambda df, i: write_batch(df, out, i), checkpoint, "append", trigger)
    else:
        each_batch(stream.agg(*counts), lambda df, i: write_batch(df, out, i), checkpoint, "complete", trigger)


def class_counts(stream: DataFrame, label: str, out: str, checkpoint: str, trigger=AVAILABLE) -> None:
    counts = stream.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("value")).agg(F.count("*").alias("n"))
    each_batch(counts, lambda df, i: write_batch(df, out, i), checkpoint, "complete", trigger)


# ---- running aggregates carried from batch to batch -------------------------------------------------------
_JOIN = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def state_versions(spark: SparkSession, state: str, batch_id: int) -> dict[int, list[int]]:
    """bucket: its versions older than the batch, the newest first. There are at most two of each but for a moment."""
    fs, path = file_system(spark, state)
    out: dict[int, list[int]] = {}
    for found in fs.globStatus(path(f"{state}/batch=*/bucket=*")) or []:
        folder = found.getPath()
        batch, bucket = (int(p.getName().split("=")[1]) for p in (folder.getParent(), folder))
        if batch < batch_id:
            out.setdefault(bucket, []).append(batch)
    return {b: sorted(v, reverse=True) for b, v in out.items()}


def remove_before(spark: SparkSession, out: str, batch_id: int, versions: dict[int, list[int]]) -> None:
    """Deletes what neither this batch, should it be repeated, nor the next one reads."""
    fs, path = file_system(spark, out)
    old = [f"{out}_state/batch={v}/bucket={b}" for b, found in versions.items() for v in found[1:]]
    for name in ("held", "mark"):
        for found in fs.globStatus(path(f"{out}_{name}/batch=*")) or []:
            if int(found.getPath().getName().split("=")[1]) < batch_id - 1:
                old.append(found.getPath().toString())
    for folder in old:
        fs.delete(path(folder), True)


def carried_running(stream: DataFrame, keys, order: str, time: str, delay: str, measures, finish, out: str, checkpoint: str,
                    keep: str | None = None, close: bool = False, trigger=AVAILABLE, buckets: int = 64) -> None:
    """Running aggregates over a stream in the order of an integer column that grows with ``time``, whatever the order of arrival.

    Rows are held until the watermark (the largest time so far less ``delay``) has passed them, then take part in order: inside a batch in
    blocks, so a hot key is spread, between batches by a carried table of totals per key. Rows that come when the watermark has passed
    them take no part; they are in ``<out>_late``. ``keep`` drops the totals of keys without rows for so long; ``close`` ends the
    stream: nothing is held back after this run.

    The totals lie in ``buckets`` parts by the hash of the key, a number that stays for the life of the stream: a batch reads and writes anew only those its rows fall
    into. Held rows and parts that no batch reads again are deleted.
    """
    keys = list(keys)
    spark, c = stream.sparkSession, F.col
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch, "batch")
        before = (lambda name: spark.read.parquet(f"{out}_{name}/batch={batch_id - 1}")) if batch_id else None
        passed = before("mark").select("mark").scalar() if before else F.lit(None)
        newest = batch.agg(F.max(time).alias("top"))
        if before:
            newest = newest.unionByName(before("mark").select("top")).agg(F.max("top").alias("top"))
        mark = c("top") if close else c("top") - F.expr(f"INTERVAL {delay}")
        write_batch(newest.select("top", F.greatest(mark, passed.cast(batch.schema[time].dataType)).alias("mark")), f"{out}_mark", batch_id)
        mark = spark.read.parquet(f"{out}_mark/batch={batch_id}").select("mark").scalar()
        late = (c(time) <= passed) if before else F.lit(False)
        write_batch(batch.where(late), f"{out}_late", batch_id)
        rows = batch.where(~late)
        rows = written(rows.unionByName(before("held")) if before else rows, "open")
        write_batch(rows.where(c(time) > mark), f"{out}_held", batch_id)
        ready = rows.where(c(time) <= mark)
        seen = running(ready, keys, order, measures)
        touched = {r[0] for r in ready.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
        versions = state_versions(spark, f"{out}_state", batch_id)
        parts = [f"{out}_state/batch={found[0]}/bucket={b}" for b, found in versions.items() if b in touched]
        new = ready.groupBy(*keys).agg(*[_TOTAL[k](v).alias(f"_{m}") for m, (k, v) in measures.items()], F.max(time).alias("_time"))
        if parts:
            old = spark.read.parquet(*parts)
            if keep:
                old = old.where(c("_time") >= passed - F.expr(f"INTERVAL {keep}"))
            seen = seen.join(old.drop("_time"), keys, "left")
            both = {m: _JOIN[k](c(m), c(f"_{m}")) for m, (k, _) in measures.items()}
            seen = seen.withColumns(both).drop(*[f"_{m}" for m in measures])
            new = old.unionByName(new).groupBy(*keys).agg(*[_TOTAL[k](f"_{m}").alias(f"_{m}") for m, (k, _) in measures.items()], F.max("_time").alias("_time"))
        if keep:
            new = new.where(c("_time") >= mark - F.expr(f"INTERVAL {keep}"))
        write_batch(finish(seen), out, batch_id)
        new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}_state/batch={batch_id}")
        remove_before(spark, out, batch_id, versions)

    each_batch(stream, step, checkpoint, trigger=trigger)


def metric_issues(stream: DataFrame, keys, order: str, time: str, delay: str, out: str, checkpoint: str, **options) -> None:
    c = F.col
    measures = {"best_score": ("max", c("val_score")), "points": ("sum", F.lit(1))}
    label = runs.history_issue(c("val_score"), c("train_score"), c("util"), c("best_score"), c("points"))
    carried_running(stream, keys, order, time, delay, measures, lambda df: df.withColumn("issue", label), out, checkpoint, **options)


def retries(stream: DataFrame, keys, order: str, time: str, delay: str, out: str, checkpoint: str, **options) -> None:
    flag = F.col("attempt") >= fixed.RETRY_LIMIT
    carried_running(stream, keys, order, time, delay, {"attempt": ("sum", F.lit(1))}, lambda df: df.withColumn("fallback", flag), out, checkpoint, **options)


# ---- missing arrivals: event-time timers ------------------------------------------------------------------
def arrival_timeouts(stream: DataFrame, delay: str, hours: float = fixed.ARRIVAL_LIMIT_HOURS) -> DataFrame:
    """(run, status, at): 'arrived' with the first submission within the limit after the start, else 'timeout'.

    Input rows are (run, kind, ts) with kind 'start' or 'submission', at most ``delay`` late. The state is two numbers per run and is
    removed when the watermark passes the limit, also of runs that have arrived and of submissions without a start; rows are
    folded one Arrow batch at a time, so a run with very many rows needs no more memory than one with few.
    """
    limit = int(hours * 3600 * 1000)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(status, ms):
            return pd.DataFrame({"run": [key[0]], "status": [status], "ms": [ms]})

        if state.hasTimedOut:
            start, _, done = state.get
            state.remove()
            if start is not None and not done:
                yield row("timeout", start + limit)
            return
        start, first, done = state.get if state.exists else (None, None, False)
        for pdf in frames:
            for kind in ("start", "submission"):
                part = pdf.loc[pdf["kind"] == kind, "ms"]
                if len(part) and kind == "start":
                    start = int(part.min()) if start is None else min(start, int(part.min()))
                elif len(part):
                    first = int(part.min()) if first is None else min(first, int(part.min()))
        if not done and start is not None and first is not None and first <= start + limit:
            yield row("arrived", first)
            done = True
        state.update((start, first, done))
        since = start if start is not None else first
        if since is not None:
            state.setTimeoutTimestamp(max(since + limit, state.getCurrentWatermarkMs() + 1))

    timed = stream.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)  # epoch time, whatever the session zone
    found = timed.groupBy("run").applyInPandasWithState(
        update, "run long, status string, ms long", "start long, first long, done boolean", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.select("run", "status", F.timestamp_millis("ms").alias("at"))
