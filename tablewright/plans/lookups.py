"""Queries: joins and lookups."""

from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.operators import lookups as lk
from tablewright.operators import sampling
from tablewright.plans.registry import query

# the event types play competitions: (bronze, silver, gold, lower is better); purchase has no thresholds
EVENT_THRESHOLDS = {
    "click": (0.5, 0.7, 0.9, False), "view": (0.4, 0.6, 0.8, False),
    "error": (0.5, 0.3, 0.1, True), "signup": (0.9, 0.95, 0.99, False),
}
THRESHOLD_SQL = "(VALUES " + ", ".join(
    f"('{k}', {a}::double, {b}::double, {c}::double, {str(low).lower()})" for k, (a, b, c, low) in EVENT_THRESHOLDS.items()
) + ") AS th(competition, bronze, silver, gold, lower_is_better)"
MEDAL_SQL = """CASE WHEN bronze IS NULL THEN 'none' WHEN NOT lower_is_better AND score >= gold OR lower_is_better AND score <= gold THEN 'gold'
    WHEN NOT lower_is_better AND score >= silver OR lower_is_better AND score <= silver THEN 'silver'
    WHEN NOT lower_is_better AND score >= bronze OR lower_is_better AND score <= bronze THEN 'bronze' ELSE 'none' END"""
MARGIN_SQL = "CASE WHEN lower_is_better THEN bronze - score ELSE score - bronze END"


def seed_runs(t):
    """Runs as (competition, seed, step, score, success, runtime_seconds, has_submission)."""
    c = F.col
    return t.runs.select(
        c("event_type").alias("competition"), (c("run") % 3).alias("seed"), "step", c("val_score").alias("score"), "success",
        (c("util") * 60.0).alias("runtime_seconds"), (c("val_score") > 0.02).alias("has_submission"),
    )


SEED_SQL = """seeds AS (SELECT event_type AS competition, run % 3 AS seed, step, val_score AS score, success,
    util * 60.0::double AS runtime_seconds, val_score > 0.02 AS has_submission FROM runs)"""


def grid(t):
    names = t.runs.select(F.col("event_type").alias("competition")).distinct()
    return lk.run_grid(seed_runs(t), names, [0, 1, 2, 3])


GRID_SQL = """grid AS (SELECT k.competition, CAST(s.seed AS BIGINT) AS seed, f.score IS NOT NULL AS found, f.score
    FROM (SELECT DISTINCT competition FROM seeds) k, (SELECT unnest([0, 1, 2, 3]) AS seed) s
    LEFT JOIN (SELECT competition, seed, arg_min(score, step) AS score FROM seeds GROUP BY 1, 2) f
      ON f.competition = k.competition AND f.seed = s.seed)"""


@query("semi_join_ids", """SELECT * FROM tab WHERE id IN (SELECT id FROM (SELECT id,
    row_number() OVER (ORDER BY md5(concat(id, ':7')), id) AS r, round_even(0.25 * count(*) OVER (), 0) AS n FROM tab) WHERE r <= n)""", ("tab",))
def semi_join_ids(t):
    return lk.semi_join_ids(t.tab, sampling.sample_fraction(t.tab.select("id"), "id", 0.25, 7), "id")


@query("run_grid", f"WITH {SEED_SQL}, {GRID_SQL} SELECT * FROM grid", ("runs",))
def run_grid(t):
    return grid(t)


@query("fuse_features", """SELECT id, array_to_string(list_transform(list_concat(coalesce(wave, list_transform(range(0, 64), lambda i: 0.0::double)), [vx, vy]), lambda v: format('{:.6f}', v)), ',') AS features,
    66 AS width, label FROM (SELECT p_partkey AS id, p_retailprice AS vx, CAST(p_size AS DOUBLE) AS vy FROM part) LEFT JOIN sig USING (id)""", ("sig",))
def fuse_features(t):
    table = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("vx"), F.col("p_size").alias("vy"))
    fused = lk.fuse_features(t.sig, table, "id", ["vx", "vy"], 64)
    f = F.col("features")
    return fused.select(
        "id", F.array_join(F.transform(f, lambda v: F.format_string("%.6f", v)), ",").alias("features"), F.size(f).alias("width"), "label"
    )


@query("grade_join", """SELECT coalesce(s.id, a.id) AS id, a.y, round(s.p, 12) AS p, coalesce(s.copies, 0) AS copies,
    CASE WHEN s.id IS NOT NULL AND a.id IS NOT NULL THEN 'matched' WHEN a.id IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
    FROM (SELECT id, avg(p) AS p, count(*) AS copies FROM sub GROUP BY 1) s
    FULL JOIN (SELECT id, y FROM pred) a ON s.id = a.id""", ("sub", "pred"))
def grade_join(t):
    return lk.grade_join(t.sub, t.pred.select("id", "y"), "id").withColumn("p", F.round("p", 12))


@query("encode_unseen", """WITH d AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS code FROM
      (SELECT DISTINCT seg FROM names WHERE bal < 2000 AND seg <> 'MACHINERY'))
    SELECT id, n.seg, coalesce(d.code, -1) AS seg_code FROM names n LEFT JOIN d ON n.seg = d.seg""", ("names",))
def encode_unseen(t):
    train = t.names.where("bal < 2000 and seg <> 'MACHINERY'")
    return lk.encode_unseen(train, t.names.select("id", "seg"), "seg")


@query("medal_band", f"""WITH {SEED_SQL} SELECT s.competition, seed, step, score, bronze IS NOT NULL AS has_threshold,
    {MEDAL_SQL} AS medal, {MARGIN_SQL} AS margin FROM seeds s LEFT JOIN {THRESHOLD_SQL} ON s.competition = th.competition""", ("runs",))
def medal_band(t):
    return lk.medal_band(seed_runs(t).select("competition", "seed", "step", "score"), lk.threshold_table(t.spark, EVENT_THRESHOLDS))


@query("lookup_default", """SELECT event_id, CASE event_type WHEN 'click' THEN 'auc' WHEN 'view' THEN 'log_loss' ELSE 'accuracy' END AS metric,
    CASE event_type WHEN 'click' THEN 'clicks' ELSE event_type END AS folder FROM events""")
def lookup_default(t):
    k = F.col("event_type")
    return t.events.select(
        "event_id", lk.lookup_default(k, {"click": "auc", "view": "log_loss"}, fixed.DEFAULT_METRIC).alias("metric"),
        lk.lookup_default(k, {"click": "clicks"}, k).alias("folder"),
    )


@query("hconcat_by_key", "SELECT s.id, s.chars, s.words, p.p FROM docstats s LEFT JOIN pred p ON s.id = p.id", ("docstats", "pred"))
def hconcat_by_key(t):
    return lk.hconcat_by_key([t.docstats.select("id", "chars"), t.docstats.select("id", "words"), t.pred.select("id", "p")], "id")


def long_predictions(t):
    c = F.col
    return t.scored.select("id", F.inline(F.array(
        F.struct(F.lit("logistic").alias("model"), c("p").alias("score")),
        F.struct(F.lit("length").alias("model"), F.round(c("x") / 40000.0, 9).alias("score")),
        F.struct(F.lit("words").alias("model"), c("words").alias("score")),
    )))


@query("stack_predictions", """SELECT id, p AS logistic, round(x / 40000.0::double, 9) AS length, words FROM scored""", ("scored",))
def stack_predictions(t):
    return lk.stack_predictions(long_predictions(t), ["logistic", "length", "words"])
