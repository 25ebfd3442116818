"""Queries: projections, predicates, column sets."""

from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions.numbers import bad_probability_sum
from tablewright.operators import columns as cl
from tablewright.plans.registry import query


@query("project_numeric", "SELECT id, price, cust, target FROM tab", ("tab",))
def project_numeric(t):
    return cl.project_numeric(t.tab)


@query("project_features", "SELECT price, cust, is_train FROM tab", ("tab",))
def project_features(t):
    return cl.project_features(t.tab, ["id", "target", "priority", "status", "not_there"])


@query("project_required", """SELECT id, TRY_CAST(p AS DOUBLE) AS p FROM
    (SELECT id, CASE WHEN p IS NULL THEN 'n/a' ELSE CAST(p AS VARCHAR) END AS p FROM sub)""", ("sub",))
def project_required(t):
    text = t.sub.select("id", F.coalesce(F.col("p").cast("string"), F.lit("n/a")).alias("p"), F.lit(1).alias("other"))
    return cl.project_required(text, ["id", "p"], ["p"])


@query("to_numeric", "SELECT c_custkey AS id, TRY_CAST(c_mktsegment AS DOUBLE) AS seg, TRY_CAST(right(c_name, 9) AS DOUBLE) AS code FROM customer")
def to_numeric(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").try_cast("double").alias("seg"),
        F.right("c_name", F.lit(9)).try_cast("double").alias("code"),
    )


@query("drop_all_null", "SELECT id, price, cust FROM tab", ("tab",))
def drop_all_null(t):
    nothing = F.lit(None).cast("double")
    return cl.drop_all_null(t.tab.select("id", "price", nothing.alias("empty"), "cust", F.lit(float("nan")).alias("nan_only")))


@query("bad_prob_rows", """SELECT id FROM (SELECT id, 0.97 * a / (a + b + c) + b / (a + b + c) + c / (a + b + c) AS s FROM multi)
    WHERE abs(s - 1) > 0.01""", ("multi",))
def bad_prob_rows(t):
    total = F.expr("a + b + c")
    probs = t.multi.select("id", (0.97 * F.col("a") / total).alias("a"), (F.col("b") / total).alias("b"), (F.col("c") / total).alias("c"))
    return probs.where(bad_probability_sum(["a", "b", "c"], fixed.SUM_TOLERANCE)).select("id")


@query("guarded_drop", f"""SELECT part, id, share < edge AS dropped FROM tab, (SELECT avg(CAST(price IS NULL AS DOUBLE)) AS share FROM tab) s,
      (VALUES ('tight', {fixed.DROP_SHARE}), ('loose', 0.10)) l(part, edge) WHERE price IS NOT NULL OR share >= edge""", ("tab",))
def guarded_drop(t):
    # 6.6 % of the prices are missing: above the usual limit of 5 %, below a limit of 10 %
    bad = F.col("price").isNull()
    tight = cl.guarded_drop(t.tab, bad, fixed.DROP_SHARE).select(F.lit("tight").alias("part"), "id", "dropped")
    loose = cl.guarded_drop(t.tab, bad, 0.10).select(F.lit("loose").alias("part"), "id", "dropped")
    return tight.unionByName(loose)


@query("schema_diff", """SELECT 'train' AS side, 'target' AS "column", count(target) AS non_null FROM labelled
    UNION ALL SELECT 'train', 'toxic', count(toxic) FROM labelled""", ("labelled",))
def schema_diff(t):
    a, b = t.labelled, t.unlabelled
    return cl.presence(a, cl.columns_only_in(a, b), "train").unionByName(cl.presence(b, cl.columns_only_in(b, a), "test"))


@query("column_check", """SELECT 'extra' AS side, 'words' AS "column", count(words) AS non_null FROM scored
    UNION ALL SELECT 'extra', 'x', count(x) FROM scored
    UNION ALL SELECT 'missing', 'score', 0 * count(*) FROM scored""", ("scored",))
def column_check(t):
    got = cl.column_check(t.scored, ["id", "p", "score"])
    absent = t.scored.agg((0 * F.count("*")).alias("non_null"), F.array(*[F.lit(c) for c in got["missing"]]).alias("c"))
    missing = absent.select(F.lit("missing").alias("side"), F.explode("c").alias("column"), "non_null")
    return cl.presence(t.scored, got["extra"], "extra").unionByName(missing)


@query("name_overlap", """SELECT DISTINCT event_type AS value FROM events WHERE event_type IN ('click', 'error', 'unknown')""")
def name_overlap(t):
    return cl.value_overlap(t.events, "event_type", ["click", "error", "unknown"])


def ragged():
    """A run's metrics as a map that holds ``train_score`` only for click events and ``util`` only for views."""
    c = F.col
    return F.map_filter(
        F.create_map(
            F.lit("val_score"), c("val_score"),
            F.lit("train_score"), F.when(c("event_type") == "click", c("train_score")),
            F.lit("util"), F.when(c("event_type") == "view", c("util")),
        ),
        lambda k, v: v.isNotNull(),
    )


def ragged_metrics(t):
    return t.runs.select("run", "step", "event_type", "success", ragged().alias("metrics"))


@query("metric_names", """SELECT 'val_score' AS metric FROM runs WHERE val_score IS NOT NULL
    UNION SELECT 'train_score' FROM runs WHERE event_type = 'click' UNION SELECT 'util' FROM runs WHERE event_type = 'view'""", ("runs",))
def metric_names(t):
    return cl.metric_names(ragged_metrics(t), "metrics")


@query("union_runs", """SELECT run, step, val_score, CAST(NULL AS DOUBLE) AS util FROM runs WHERE success
    UNION ALL SELECT run, step, NULL, util FROM runs WHERE NOT success""", ("runs",))
def union_runs(t):
    a = t.runs.where("success").select("run", "step", "val_score")
    b = t.runs.where("not success").select("run", "step", "util")
    return cl.union_ragged([a, b])
