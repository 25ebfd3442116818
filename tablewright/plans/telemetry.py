"""Queries: logs, grader output, report records."""

from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions import logtext as lt
from tablewright.functions.strings import any_keyword
from tablewright.plans.ordering import CLASS_SQL
from tablewright.plans.registry import query


def first_sql(col, patterns, cast=True):
    parts = [f"nullif(regexp_extract({col}, '(?i){p}', 1), '')" for p in patterns]
    parts = [f"TRY_CAST({p} AS DOUBLE)" if cast else p for p in parts]
    return "coalesce(" + ", ".join(parts) + ")"


def long_log(t):
    """Run output of several lines: scores, the chosen model and what was saved."""
    c = F.col
    return t.events.select(
        c("event_id").alias("id"),
        F.concat(
            F.lit("Train score: "), F.format_string("%.3f", c("value") / 490), F.lit("\n"),
            F.when(c("event_type") == "click", F.concat(F.lit("Best validation score: "), F.format_string("%.5f", c("value") / 500), F.lit("\n"))).otherwise(""),
            F.when(c("event_type") == "view", F.concat(F.lit("roc_auc: "), F.format_string("%.5f", c("value") / 500), F.lit("\n"))).otherwise(""),
            F.lit("best_estimator: lgbm\nBEST LOSS: "), F.format_string("%.2f", c("value")),
            F.when(c("event_type") == "error", "\nabc\nTraceback (most recent call last):\n  boom").otherwise("\nSaved model"),
        ).alias("log"),
    )


LONG_SQL = """longlog AS (SELECT event_id AS id, concat('Train score: ', format('{:.3f}', value / 490), chr(10),
    CASE WHEN event_type = 'click' THEN concat('Best validation score: ', format('{:.5f}', value / 500), chr(10)) ELSE '' END,
    CASE WHEN event_type = 'view' THEN concat('roc_auc: ', format('{:.5f}', value / 500), chr(10)) ELSE '' END,
    'best_estimator: lgbm', chr(10), 'BEST LOSS: ', format('{:.2f}', value),
    CASE WHEN event_type = 'error' THEN concat(chr(10), 'abc', chr(10), 'Traceback (most recent call last):', chr(10), '  boom')
      ELSE concat(chr(10), 'Saved model') END) AS log FROM events)"""


@query("log_metrics", f"""WITH {LONG_SQL} SELECT id, {first_sql('log', fixed.LOG_PATTERNS['val_score'])} AS val_score,
    {first_sql('log', fixed.LOG_PATTERNS['train_score'])} AS train_score, {first_sql('log', fixed.LOG_PATTERNS['best_model'], False)} AS best_model,
    {first_sql('log', fixed.LOG_PATTERNS['best_loss'])} AS best_loss,
    regexp_matches(lower(log), 'training complete|submission\\.csv|saved') AS completed FROM longlog""")
def log_metrics(t):
    return long_log(t).select("id", *[v.alias(k) for k, v in lt.log_metrics(F.col("log")).items()])


@query("grader_text", r"""WITH g AS (SELECT event_id AS id, CASE event_type
      WHEN 'click' THEN concat('Report: {"score": ', format('{:.5f}', value / 500), ', "medal": "Silver"} done')
      WHEN 'view' THEN concat('Gold medal, AUC: ', format('{:.5f}', value / 500))
      WHEN 'error' THEN '{not json} Bronze 0.25 accuracy'
      WHEN 'signup' THEN concat('{"medal": "gold"} score ', format('{:.5f}', value / 500)) ELSE 'no result' END AS out, event_type, value FROM events)
    SELECT id, CASE event_type WHEN 'click' THEN CAST(regexp_extract(out, '"score": ([0-9.]+)', 1) AS DOUBLE) WHEN 'view' THEN CAST(regexp_extract(out, 'AUC: ([0-9.]+)', 1) AS DOUBLE)
      WHEN 'error' THEN 0.25::double ELSE 0.0::double END AS score,
      CASE event_type WHEN 'click' THEN 'silver' WHEN 'view' THEN 'gold' WHEN 'error' THEN 'bronze' WHEN 'signup' THEN 'gold' ELSE 'none' END AS medal FROM g""")
def grader_text(t):
    c, num = F.col, F.format_string("%.5f", F.col("value") / 500)
    out = (
        F.when(c("event_type") == "click", F.concat(F.lit('Report: {"score": '), num, F.lit(', "medal": "Silver"} done')))
        .when(c("event_type") == "view", F.concat(F.lit("Gold medal, AUC: "), num))
        .when(c("event_type") == "error", "{not json} Bronze 0.25 accuracy")
        .when(c("event_type") == "signup", F.concat(F.lit('{"medal": "gold"} score '), num)).otherwise("no result")
    )
    return t.events.select(c("event_id").alias("id"), lt.grader_result(out).alias("g")).select("id", "g.*")


@query("error_class", f"SELECT id, {CLASS_SQL} AS error_class FROM logs", ("logs",))
def error_class(t):
    return t.logs.select("id", lt.error_class(F.col("log")).alias("error_class"))


def action_sql(field):
    at = {"action": 2, "priority": 3}[field]
    parts = []
    for r in fixed.ERROR_ACTIONS:
        words = f" AND regexp_matches(lower(log), '{any_keyword(r[1])}')" if r[1] else ""
        value = f"'{r[at]}'" if field == "action" else r[at]
        parts.append(f"WHEN error_class = '{r[0]}'{words} THEN {value}")
    return "CASE " + " ".join(parts) + " END"


@query("error_action", f"SELECT id, error_class, {action_sql('action')} AS action, {action_sql('priority')} AS priority FROM (SELECT id, log, {CLASS_SQL} AS error_class FROM logs)", ("logs",))
def error_action(t):
    got = t.logs.select("id", "log", lt.error_class(F.col("log")).alias("error_class"))
    return got.select("id", "error_class", lt.error_action(F.col("error_class"), F.col("log")).alias("a")).select("id", "error_class", "a.*")


@query("critical_error", f"""SELECT id, exit_code <> 0 OR regexp_matches(lower(log), '{any_keyword(fixed.CRITICAL_KEYWORDS)}') AS critical FROM logs""", ("logs",))
def critical_error(t):
    return t.logs.select("id", lt.critical_error(F.col("exit_code"), F.col("log")).alias("critical"))


@query("stack_trace", f"""WITH {LONG_SQL} SELECT id, CASE WHEN log LIKE '%Traceback%' THEN substr(log, position('Traceback' IN log)) END AS trace,
    right(log, 40) AS tail FROM longlog""")
def stack_trace(t):
    return long_log(t).select("id", lt.stack_trace(F.col("log")).alias("trace"), lt.tail(F.col("log"), 40).alias("tail"))


@query("fenced_block", """SELECT conv_id, turn, CASE role WHEN 'user' THEN role WHEN 'assistant' THEN 'plain ' || CAST(turn AS VARCHAR) END AS block,
    CASE role WHEN 'user' THEN CAST(length(text) AS BIGINT) END AS n FROM conversations""")
def fenced_block(t):
    c, fence = F.col, F.lit("```")
    body = F.to_json(F.struct(c("role").alias("role"), F.length("text").alias("n")))
    text = (
        F.when(c("role") == "user", F.concat(c("text"), F.lit("\n"), fence, F.lit("json\n"), body, F.lit("\n"), fence, F.lit(" end")))
        .when(c("role") == "assistant", F.concat(F.lit("see "), fence, F.lit("\nplain "), c("turn").cast("string"), F.lit("\n"), fence))
        .otherwise(c("text"))
    )
    got = t.conversations.select("conv_id", "turn", "role", lt.fenced_block(text, "json").alias("b"))
    parsed = F.from_json("b", "role string, n long")
    return got.select(
        "conv_id", "turn", F.when(c("role") == "user", parsed["role"]).otherwise(c("b")).alias("block"),
        F.when(c("role") == "user", parsed["n"]).alias("n"),
    )


@query("time_format", """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, value / 3600.0::double AS hours FROM events""")
def time_format(t):
    return t.events.select(
        "event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.col("value") / 3600.0).alias("hours"),
    )


@query("report_json", """SELECT run, step, 'val_score' AS metric, val_score AS value FROM runs
    UNION ALL SELECT run, step, 'util', util FROM runs""", ("runs",))
def report_json(t):
    pairs = F.array(
        F.struct(F.lit("val_score").alias("key"), F.col("val_score").alias("value")),
        F.struct(F.lit("util").alias("key"), F.col("util").alias("value")),
    )
    text = F.to_json(F.struct("run", "step", F.map_from_entries(pairs).alias("metrics")))
    back = t.runs.select(F.from_json(text, "run long, step long, metrics map<string, double>").alias("r"))
    return back.select("r.run", "r.step", F.explode("r.metrics").alias("metric", "value"))


@query("nested_metrics", """SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN value END AS execution_time_seconds,
    CASE WHEN event_type <> 'error' THEN 0.0::double END AS gpu_memory_used_gb, 0.0::double AS validation_score,
    CASE WHEN event_type = 'click' THEN value * 2 END AS total_runtime_seconds,
    1 + CASE WHEN event_type <> 'error' THEN 2 ELSE 0 END + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS n_metrics FROM events""")
def nested_metrics(t):
    c = F.col
    record = F.to_json(F.struct(
        F.when(c("event_type") != "error", F.struct(c("value").alias("execution_time"))).alias("execution"),
        F.when(c("event_type") == "click", c("value") * 2).alias("total_runtime_seconds"),
    ))
    schema = "execution struct<execution_time: double, gpu_memory_used_gb: double, validation_score: double>, total_runtime_seconds double"
    r = t.events.select(c("event_id").alias("id"), F.from_json(record, schema).alias("r"))
    m = metrics_of(c("r"))
    names = ["execution_time_seconds", "gpu_memory_used_gb", "validation_score", "total_runtime_seconds"]
    return r.select("id", m.alias("m")).select("id", *[F.try_element_at("m", F.lit(n)).alias(n) for n in names], F.size("m").alias("n_metrics"))


def metrics_of(r):
    """Flat metrics of a nested run record; keys whose part is absent are left out, absent numbers count as 0."""
    run = r["execution"]
    zero = F.lit(0.0)
    all_of = F.create_map(
        F.lit("execution_time_seconds"), F.when(run.isNotNull(), F.coalesce(run["execution_time"], zero)),
        F.lit("gpu_memory_used_gb"), F.when(run.isNotNull(), F.coalesce(run["gpu_memory_used_gb"], zero)),
        F.lit("validation_score"), F.coalesce(run["validation_score"], zero),
        F.lit("total_runtime_seconds"), r["total_runtime_seconds"],
    )
    return F.map_filter(all_of, lambda k, v: v.isNotNull())
