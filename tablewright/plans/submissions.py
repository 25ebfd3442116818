"""Queries: submission tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import numbers as nm
from tablewright.operators import submission as sb
from tablewright.operators import metrics
from tablewright.operators import models as md
from tablewright.plans.learning import table_parts
from tablewright.plans.registry import query
from tablewright.session import checkpointed, file_system, scratch
from tablewright.sources import readers


@query("predictions_table", """SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, a / (a + b) AS yes, b / (a + b) AS no
    FROM (SELECT event_id, value AS a, 500 - value AS b FROM events)""")
def predictions_table(t):
    scored = t.events.select("event_id", F.col("value").alias("yes"), (500 - F.col("value")).alias("no"))
    return sb.predictions_table(scored, "id", ["yes", "no"], "event_id")


@query("wide_probabilities", """SELECT id, a / (a + b + c) AS EAP, b / (a + b + c) AS HPL, c / (a + b + c) AS MWS FROM multi""", ("multi",))
def wide_probabilities(t):
    p = nm.normalize_probs(["a", "b", "c"])
    pairs = [F.struct(F.lit(k).alias("class"), v.alias("p")) for k, v in zip(["EAP", "HPL", "MWS"], p)]
    return sb.wide_probabilities(t.multi.select("id", F.inline(F.array(*pairs))), ["MWS", "EAP", "HPL"])


@query("validate_submission", """SELECT false AS is_valid, concat('Column ''p'' has ', count(*) FILTER (WHERE p IS NULL), ' missing values; ',
      'Row count mismatch: expected ', (SELECT count(*) FROM documents), ', got ', count(*), '; ',
      'Found ', count(*) - count(DISTINCT id), ' duplicate IDs') AS errors,
    concat('Extra columns present (will be ignored): note; ', count(*) FILTER (WHERE abs(coalesce(p, 0) + coalesce(q, 0) - 1) > 0.01),
      ' rows have probabilities not summing to 1') AS warnings
    FROM (SELECT id, p, CASE WHEN p = 0.5 THEN 0.7::double ELSE 1 - coalesce(p, 0) END AS q FROM sub)""", ("sub",))
def validate_submission(t):
    p = F.col("p")
    two = t.sub.select("id", "p", F.when(p == 0.5, 0.7).otherwise(1 - F.coalesce(p, F.lit(0.0))).alias("q"), F.lit("x").alias("note"))
    r = sb.validate_submission(two, "id", ["p", "q"], t.documents)
    return r.select("is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("submission_flow", "SELECT id, p AS target, true AS is_valid FROM scored", ("scored",))
def submission_flow(t):
    folder = scratch(t.spark, "submissions")
    raw = t.scored.select("id", F.col("p").cast("string").alias("target"), "x")
    path = sb.save_submission(raw, "id", ["target"], t.documents, folder, "20240131_120000", "baseline", 42)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("target", T.DoubleType())])
    saved = readers.read_csv(t.spark, path, schema)
    return saved.withColumn("is_valid", sb.validate_submission(saved, "id", ["target"], t.documents).select("is_valid").scalar())


@query("published_scores", "SELECT id, true AS same, true AS informed, 1 AS published FROM docstats WHERE NOT is_train", ("docstats",))
def published_scores(t):
    """Scores of a fitted model as a published submission: per id whether the file holds its score; whether the scores rank the labels better than chance, and
    how many submissions are visible after one good and one broken attempt."""
    train, test = table_parts(t)
    scores = checkpointed(md.batch_score(md.forest(2, numTrees=10).fit(train), test, "id"))
    folder = scratch(t.spark, "published")
    path = sb.publish_submission(scores, "id", ["prediction"], test, folder, "20240131_120000", "forest", 42)
    broken = scores.withColumn("prediction", F.when(F.col("id") % 2 == 0, F.col("prediction")))
    try:
        sb.publish_submission(broken, "id", ["prediction"], test, folder, "20240131_130000")
    except ValueError:
        pass
    fs, to_path = file_system(t.spark, folder)
    visible = len(fs.listStatus(to_path(folder)))
    saved = readers.read_csv(t.spark, path, scores.schema)
    auc = metrics.auc(saved.join(test.select("id", "label"), "id"), "label", ["prediction"]).first()["auc"]
    both = saved.withColumnRenamed("prediction", "p").join(scores, "id", "full")
    return both.select("id", (F.col("p") == F.col("prediction")).alias("same"), F.lit(auc > 0.55).alias("informed"), F.lit(visible).alias("published"))
