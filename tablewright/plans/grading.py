"""Queries: evaluation metrics and grading."""

from pyspark.sql import functions as F

from tablewright.functions import numbers as nm
from tablewright.operators import lookups as lk
from tablewright.operators import metrics as mt
from tablewright.operators import submission as sb
from tablewright.plans.registry import query

AUC_SQL = """(sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::double)
    / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0)"""


def auc_sql(source, col):
    return f"""(SELECT {AUC_SQL} FROM (SELECT y, rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0::double AS r FROM {source}))"""


@query("metric_auc", " UNION ALL ".join(f"SELECT '{c}' AS name, round({auc_sql('pred', c)}, 9) AS auc" for c in ("p", "words")), ("pred",))
def metric_auc(t):
    return mt.auc(t.pred, "y", ["p", "words"]).withColumn("auc", F.round("auc", 9))


MULTI_P = "list_value(a / (a + b + c), b / (a + b + c), c / (a + b + c))"


def multi_probs():
    return F.array(*nm.normalize_probs(["a", "b", "c"]))


@query("metric_logloss", f"""SELECT 'binary' AS kind, round(avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15), 1 - 1e-15))), 9) AS log_loss FROM pred
    UNION ALL SELECT 'multi', round(avg(-ln({MULTI_P}[y + 1])), 9) FROM multi""", ("pred", "multi"))
def metric_logloss(t):
    a = t.pred.agg(F.lit("binary").alias("kind"), F.round(mt.log_loss(F.col("p"), F.col("y")), 9).alias("log_loss"))
    b = t.multi.agg(F.lit("multi").alias("kind"), F.round(mt.multi_log_loss(multi_probs(), F.col("y")), 9).alias("log_loss"))
    return a.unionByName(b)


@query("metric_accuracy", f"""SELECT 'binary' AS kind, round(avg(CAST((p >= 0.5)::INTEGER = y AS DOUBLE)), 9) AS accuracy FROM pred
    UNION ALL SELECT 'multi', round(avg(CAST(list_position({MULTI_P}, list_max({MULTI_P})) - 1 = y AS DOUBLE)), 9) FROM multi""", ("pred", "multi"))
def metric_accuracy(t):
    a = t.pred.agg(F.lit("binary").alias("kind"), F.round(mt.accuracy(F.col("y"), (F.col("p") >= 0.5).cast("int")), 9).alias("accuracy"))
    m = t.multi.select("y", nm.argmax(multi_probs()).alias("yhat"))
    return a.unionByName(m.agg(F.lit("multi").alias("kind"), F.round(mt.accuracy(F.col("y"), F.col("yhat")), 9).alias("accuracy")))


@query("metric_rmse_mae", """SELECT event_type, round(sqrt(avg((val_score - train_score) ** 2)), 9) AS rmse,
    round(avg(abs(val_score - train_score)), 9) AS mae FROM runs GROUP BY 1""", ("runs",))
def metric_rmse_mae(t):
    y, z = F.col("val_score"), F.col("train_score")
    return t.runs.groupBy("event_type").agg(F.round(mt.rmse(y, z), 9).alias("rmse"), F.round(mt.mae(y, z), 9).alias("mae"))


@query("metric_f1", """SELECT round(2.0::double * tp / (2 * tp + fp + fn), 9) AS f1 FROM (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
    count(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn FROM pred)""", ("pred",))
def metric_f1(t):
    return t.pred.agg(F.round(mt.f1(F.col("y"), (F.col("p") >= 0.5).cast("int")), 9).alias("f1"))


@query("metric_r2", """SELECT event_type, round(1 - sum((val_score - train_score) ** 2) / sum((val_score - m) ** 2), 9) AS r2
    FROM (SELECT *, avg(val_score) OVER (PARTITION BY event_type) AS m FROM runs) GROUP BY 1""", ("runs",))
def metric_r2(t):
    return t.runs.groupBy("event_type").agg(F.round(mt.r2(F.col("val_score"), F.col("train_score")), 9).alias("r2"))


# one clean submission per metric and a flawed one: (bronze, silver, gold, lower is better)
QUALITY = {
    "clean_auc": (0.4, 0.6, 0.8, False), "clean_log_loss": (3.0, 1.0, 0.5, True), "clean_accuracy": (0.3, 0.8, 0.9, False),
    "flawed": (0.0, 0.1, 0.2, False), "incomplete": (0.0, 0.1, 0.2, False), "unscored": (0.0, 0.1, 0.2, False),
}
GRADED_BY = {"clean_auc": "auc", "clean_log_loss": "log_loss", "clean_accuracy": "accuracy", "flawed": "auc", "incomplete": "accuracy", "unscored": "accuracy"}
_TH = "(VALUES " + ", ".join(f"('{k}', {a}::double, {b}::double, {c}::double, {str(low).lower()})" for k, (a, b, c, low) in QUALITY.items()) + ") AS th(competition, bronze, silver, gold, lower_is_better)"
_LOSS = "round(avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15), 1 - 1e-15))), 9)"


@query("grade_submission", f"""WITH f AS (SELECT id, count(*) AS copies, count(*) FILTER (WHERE p IS NULL) AS nulls FROM sub GROUP BY 1),
    fl AS (SELECT 'flawed' AS competition, count(*) FILTER (WHERE f.id IS NOT NULL AND a.id IS NOT NULL) AS matched, count(*) FILTER (WHERE f.id IS NULL) AS missing,
      count(*) FILTER (WHERE a.id IS NULL) AS extra, count(*) FILTER (WHERE copies > 1) AS repeated, count(*) FILTER (WHERE nulls > 0) AS unscored,
      CASE WHEN count(*) FILTER (WHERE f.id IS NULL) > 0 THEN 'missing ids' WHEN count(*) FILTER (WHERE a.id IS NULL) > 0 THEN 'unknown ids' END AS reason, NULL::double AS score
      FROM f FULL JOIN pred a ON f.id = a.id),
    n AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 5 <> 0) AS most, count(*) FILTER (WHERE id % 5 = 0) AS fifth FROM pred),
    g AS (SELECT 'clean_auc' AS competition, n AS matched, 0 AS missing, 0 AS extra, 0 AS repeated, 0 AS unscored, NULL::varchar AS reason, {auc_sql('pred', 'p')} AS score FROM n
      UNION ALL SELECT 'clean_log_loss', n, 0, 0, 0, 0, NULL, (SELECT {_LOSS} FROM pred) FROM n
      UNION ALL SELECT 'clean_accuracy', n, 0, 0, 0, 0, NULL, (SELECT avg(CAST((p >= 0.5)::INTEGER = y AS DOUBLE)) FROM pred) FROM n
      UNION ALL SELECT 'incomplete', most, fifth, 0, 0, 0, CASE WHEN fifth > 0 THEN 'missing ids' END, NULL FROM n
      UNION ALL SELECT 'unscored', n, 0, 0, 0, fifth, CASE WHEN fifth > 0 THEN 'missing predictions' END, NULL FROM n
      UNION ALL SELECT * FROM fl)
    SELECT g.competition, matched, missing, extra, repeated, unscored, reason, round(score, 9) AS score, true AS has_threshold,
      CASE WHEN score IS NULL THEN 'none' WHEN lower_is_better AND score <= gold OR NOT lower_is_better AND score >= gold THEN 'gold'
        WHEN lower_is_better AND score <= silver OR NOT lower_is_better AND score >= silver THEN 'silver'
        WHEN lower_is_better AND score <= bronze OR NOT lower_is_better AND score >= bronze THEN 'bronze' ELSE 'none' END AS medal,
      round(CASE WHEN lower_is_better THEN bronze - score ELSE score - bronze END, 9) AS margin FROM g JOIN {_TH} USING (competition)""", ("sub", "pred"))
def grade_submission(t):
    answers, thresholds, c = t.pred.select("id", "y"), lk.threshold_table(t.spark, QUALITY), F.col
    clean = t.pred.select("id", "p")
    kinds = {
        "flawed": t.sub, "incomplete": clean.where("id % 5 <> 0"),
        "unscored": clean.withColumn("p", F.when(c("id") % 5 == 0, F.lit(float("nan"))).otherwise(c("p"))),
    }
    out = None
    for metric in ("auc", "log_loss", "accuracy"):
        subs = None
        for name, by in GRADED_BY.items():
            if by == metric:
                one = kinds.get(name, clean).select(F.lit(name).alias("competition"), "id", "p")
                subs = one if subs is None else subs.unionByName(one)
        graded = sb.grade_submissions(subs, answers, "id", metric, thresholds)
        out = graded if out is None else out.unionByName(graded)
    return out.withColumns({"score": F.round("score", 9), "margin": F.round("margin", 9)})
