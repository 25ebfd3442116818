"""Queries: ranks, run histories, samples, splits, top-k."""

from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions import logtext
from tablewright.operators import ordered, runs, sampling
from tablewright.operators import statistics as st
from tablewright.plans.registry import query

MD5_RANK = "row_number() OVER ({part} ORDER BY md5(concat(id, ':{seed}')), id)"


@query("rank_ensemble", """SELECT id, round((rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::double
    + rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double
    + rank() OVER (ORDER BY words) + (count(*) OVER (PARTITION BY words) - 1) / 2.0::double) / 3, 9) AS mean_rank FROM scored""", ("scored",))
def rank_ensemble(t):
    ranks = ordered.average_ranks(t.scored, "id", ["p", "x", "words"])
    return ranks.groupBy("id").agg(F.round(F.avg("rank"), 9).alias("mean_rank"))


@query("running_best", """SELECT run, step, val_score, max(val_score) OVER (PARTITION BY run ORDER BY step) AS best_score,
    row_number() OVER (PARTITION BY run ORDER BY step) AS points FROM runs""", ("runs",))
def running_best(t):
    return runs.running_best(t.runs.select("run", "step", "val_score"), ["run"], "step", "val_score")


STATELESS = """CASE WHEN train_score - val_score > 0.15::double THEN 'overfitting' WHEN train_score < 0.7::double THEN 'underfitting'
    WHEN util < 60 THEN 'resource_inefficiency' ELSE 'healthy' END"""
ISSUE_SQL = f"""SELECT run, step, CASE WHEN points < 2 THEN 'insufficient_data'
      WHEN val_score < best - 0.05::double THEN 'significant_regression' WHEN val_score < best - 0.02::double THEN 'minor_regression'
      ELSE {STATELESS} END AS issue
    FROM (SELECT *, max(val_score) OVER w AS best, row_number() OVER w AS points FROM runs WINDOW w AS (PARTITION BY run ORDER BY step))"""


@query("metric_issues", ISSUE_SQL, ("runs",))
def metric_issues(t):
    return runs.metric_issues(t.runs, ["run"], "step").select("run", "step", "issue")


@query("metric_issues_stateless", f"SELECT run, step, {STATELESS} AS issue FROM runs", ("runs",))
def metric_issues_stateless(t):
    return t.runs.select("run", "step", runs.issue(F.col("val_score"), F.col("train_score"), F.col("util")).alias("issue"))


@query("early_stop", """WITH a AS (SELECT run, step, 1 - val_score AS loss, row_number() OVER w AS epoch,
      min(1 - val_score) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
      FROM runs WINDOW w AS (PARTITION BY run ORDER BY step)),
    b AS (SELECT *, max(CASE WHEN low IS NULL OR loss < low THEN epoch END) OVER (PARTITION BY run ORDER BY step) AS last_e FROM a),
    e AS (SELECT run, bool_or(epoch - last_e >= 5) AS stopped,
      coalesce(min(epoch) FILTER (WHERE epoch - last_e >= 5), max(epoch)) AS epochs FROM b GROUP BY 1)
    SELECT e.run, e.stopped, b.step AS stop_step, e.epochs, c.step AS best_step, c.loss AS best_loss
    FROM e JOIN b ON b.run = e.run AND b.epoch = e.epochs JOIN b c ON c.run = e.run AND c.epoch = b.last_e""", ("runs",))
def early_stop(t):
    losses = t.runs.select("run", "step", (1 - F.col("val_score")).alias("loss"))
    return runs.early_stop(losses, "run", "step", "loss", 5)


CLASS_SQL = """CASE WHEN regexp_matches(lower(log), 'out of memory|oom|cuda|memory error|timeout|killed|resource|vram') THEN 'resource'
    WHEN regexp_matches(lower(log), 'filenotfound|no such file|missing|corrupt|invalid data|cannot open|file does not exist|permission denied|io error') THEN 'data'
    WHEN regexp_matches(lower(log), 'nan|inf|gradient|loss|convergence|training|exploding|vanishing|overflow') THEN 'model'
    WHEN regexp_matches(lower(log), 'syntax|import|attribute|type error|name error|indentation|module|undefined') THEN 'code' ELSE 'unknown' END"""


def errors(t):
    return t.logs.select("id", "session", logtext.error_class(F.col("log")).alias("error_class"))


RETRY_SQL = f"""SELECT id, session, error_class, attempt, attempt >= 3 AS fallback FROM (SELECT id, session, error_class,
    row_number() OVER (PARTITION BY session, error_class ORDER BY id) AS attempt FROM (SELECT id, session, {CLASS_SQL} AS error_class FROM logs))"""


@query("retry_counter", RETRY_SQL, ("logs",))
def retry_counter(t):
    return runs.retry_counter(errors(t), ["session", "error_class"], "id")


ACCEPT_SQL = "CASE WHEN NOT success THEN false WHEN val_score < 0.5::double THEN false WHEN train_score - val_score > 0.25::double THEN false ELSE true END"


def accepted(t):
    c = F.col
    ok = st.acceptable(c("success"), F.lit(True), c("val_score"), c("train_score"), fixed.ACCEPT_SCORE, fixed.ACCEPT_GAP)
    return t.runs.select("run", "step", ok.alias("acceptable"))


@query("run_acceptable", f"""SELECT run, step, {ACCEPT_SQL} AS acceptable, CASE WHEN NOT success THEN false
    WHEN val_score < 0.4::double THEN false WHEN train_score - val_score > 0.30::double THEN false ELSE true END AS acceptable_relaxed FROM runs""", ("runs",))
def run_acceptable(t):
    c = F.col
    given = (c("success"), F.lit(True), c("val_score"), c("train_score"))
    return t.runs.select(
        "run", "step", st.acceptable(*given, fixed.ACCEPT_SCORE, fixed.ACCEPT_GAP).alias("acceptable"),
        st.acceptable(*given, fixed.RELAXED_ACCEPT_SCORE, fixed.RELAXED_ACCEPT_GAP).alias("acceptable_relaxed"),
    )


@query("iteration_cap", f"""SELECT run, step, acceptable, iteration, CASE WHEN iteration > 3 THEN 'accept_limit' WHEN acceptable THEN 'accept' ELSE 'retry' END AS decision
    FROM (SELECT run, step, {ACCEPT_SQL} AS acceptable, row_number() OVER (PARTITION BY run ORDER BY step) AS iteration FROM runs)""", ("runs",))
def iteration_cap(t):
    return runs.iteration_cap(accepted(t), "run", "step")


@query("resource_alerts", """SELECT run, step, CASE WHEN util / 100 >= 0.90::double THEN 'GPU_OOM_PREVENTION'
    WHEN val_score >= 0.90::double THEN 'RAM_CLEANUP' WHEN train_score >= 0.80::double THEN 'TIMEOUT_APPROACHING' END AS alert FROM runs""", ("runs",))
def resource_alerts(t):
    c = F.col
    return t.runs.select("run", "step", runs.resource_alert(c("util") / 100, c("val_score"), c("train_score")).alias("alert"))


@query("sample_fraction", f"""SELECT id FROM (SELECT id, {MD5_RANK.format(part='', seed=42)} AS r,
    round_even(0.1 * count(*) OVER (), 0) AS n FROM tab) WHERE r <= n""", ("tab",))
def sample_fraction(t):
    return sampling.sample_fraction(t.tab, "id", 0.1, 42).select("id")


@query("sample_cap", f"SELECT id FROM (SELECT id, {MD5_RANK.format(part='', seed=42)} AS r FROM tab) WHERE r <= 777", ("tab",))
def sample_cap(t):
    return sampling.sample_cap(t.tab, "id", 777, 42).select("id")


@query("split_random", "SELECT id, left(md5(concat(id, ':42')), 8) < '19999999' AS is_validation FROM tab", ("tab",))
def split_random(t):
    return sampling.split_random(t.tab, "id", 0.1, 42).select("id", "is_validation")


@query("split_stratified", f"""SELECT id, status, r <= round_even(0.1 * n, 0) AS is_validation FROM (SELECT id, status,
    {MD5_RANK.format(part='PARTITION BY status', seed=42)} AS r, count(*) OVER (PARTITION BY status) AS n FROM tab)""", ("tab",))
def split_stratified(t):
    return sampling.split_stratified(t.tab.select("id", "status"), "id", "status", 0.1, 42)


@query("kfold_stratified", f"""SELECT id, status, CAST({MD5_RANK.format(part='PARTITION BY status', seed=42)} % 5 AS INTEGER) AS fold FROM tab""", ("tab",))
def kfold_stratified(t):
    return sampling.kfold_stratified(t.tab.select("id", "status"), "id", "status", 5, 42)


@query("top_k", "SELECT id, price FROM tab WHERE price IS NOT NULL ORDER BY price DESC, id LIMIT 20", ("tab",))
def top_k(t):
    return t.tab.where("price is not null").select("id", "price").orderBy(F.desc("price"), "id").limit(20)


CAUSE_TESTS = ["train_score - val_score > 0.15::double", "train_score < 0.7::double", "util < 60"]


def cause_sql(field):
    at = {"cause": 1, "fix": 2, "priority": 0}[field]
    parts = ", ".join(f"CASE WHEN {c} THEN '{v[at]}' END" for c, v in zip(CAUSE_TESTS, fixed.CAUSES))
    return f"coalesce(nullif(concat_ws('; ', {parts}), ''), '{fixed.NORMAL_CAUSE[at]}')"


@query("cause_list", f"SELECT run, step, {cause_sql('priority')} AS priorities, {cause_sql('cause')} AS causes, {cause_sql('fix')} AS fixes FROM runs", ("runs",))
def cause_list(t):
    c = F.col
    found = t.runs.select("run", "step", runs.cause_list(c("train_score"), c("val_score"), c("util")).alias("x"))
    return found.select(
        "run", "step", F.array_join(F.transform("x.priority", lambda p: p.cast("string")), "; ").alias("priorities"),
        F.array_join("x.cause", "; ").alias("causes"), F.array_join("x.fix", "; ").alias("fixes"),
    )


@query("order_actions", """SELECT id, CASE WHEN exit_code <> 0 THEN 'restart,' ELSE '' END || CASE WHEN log LIKE '%memory%' THEN 'reduce_batch,' ELSE '' END
    || CASE WHEN log LIKE '%NaN%' THEN 'lower_rate,' ELSE '' END || 'log' AS actions FROM logs""", ("logs",))
def order_actions(t):
    c = F.col

    def act(cond, priority, name):
        return F.when(cond, F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("action")))

    acts = F.array(
        act(F.lit(True), 9, "log"), act(c("log").contains("NaN"), 3, "lower_rate"),
        act(c("exit_code") != 0, 0, "restart"), act(c("log").contains("memory"), 1, "reduce_batch"),
    )
    df = t.logs.select("id", F.filter(acts, lambda x: x.isNotNull()).alias("actions"))
    return runs.order_actions(df, "actions").select("id", F.array_join("actions.action", ",").alias("actions"))
