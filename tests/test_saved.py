"""Fitted models give the same rows after they were saved and loaded, also in another process."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablewright.operators import features as ft
from tablewright.operators import lookups, statistics, submission
from tablewright.operators import models as md
from tablewright.operators.text import TfIdf, TfIdfModel
from tablewright.operators.vectors import TextVectors, TextVectorsModel

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OTHER = """
import sys
from pyspark.ml import PipelineModel
from tablewright.session import build_session
spark = build_session("other", "local[2]", 2)
model = PipelineModel.load(sys.argv[1])
model.transform(spark.read.parquet(sys.argv[2])).write.parquet(sys.argv[3])
"""


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def toy(spark):
    values = [(i, float(i * 37 % 101) if i % 9 else None, float(i * 53 % 89), "abc"[i % 3] if i % 5 else None) for i in range(120)]
    return spark.createDataFrame(values, "id long, a double, b double, kind string").withColumn("label", (F.col("id") % 3 == 0).cast("double"))


def test_pipeline_in_another_process(spark, tmp_path):
    df = toy(spark)
    model = md.table_features(["a", "b"], ["kind"]).fit(df)
    path, data, out = (str(tmp_path / n) for n in ("model", "data", "out"))
    model.write().save(path)
    df.write.parquet(data)
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", OTHER, path, data, out], check=True, env=env, timeout=300)
    assert rows(spark.read.parquet(out)) == rows(model.transform(df))


def test_every_preparation(spark, tmp_path):
    df = toy(spark).withColumn("code", F.format_string("x%02d", F.col("id") % 100))
    df = df.withColumn("before", F.col("kind")).withColumn("after", F.upper("kind"))
    stages = [ft.Interactions(["a", "b", "label"]), ft.StandardScaler(["b"]), ft.CharFeatures(skip=("kind", "before", "after")), ft.TargetEncoder("kind", "b"), ft.SequenceNormalizer()]
    for n, stage in enumerate(stages):
        model = stage.fit(df)
        model.write().save(str(tmp_path / str(n)))
        model.write().overwrite().save(str(tmp_path / str(n)))
        assert rows(type(model).load(str(tmp_path / str(n))).transform(df)) == rows(model.transform(df))
    empty = ft.LabelEncoder("kind").fit(df.limit(0))
    empty.write().save(str(tmp_path / "empty"))
    assert rows(type(empty).load(str(tmp_path / "empty")).transform(df)) == rows(empty.transform(df))


@pytest.mark.parametrize("kind", ["word", "char"])
def test_text_models(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, None), (4, "one four two")], "id long, text string")
    model = TfIdf("id", "text", kind, min_df=1, max_df=1.0).fit(df.where("id < 4"))
    model.write().save(str(tmp_path / "rows"))
    assert rows(TfIdfModel.load(str(tmp_path / "rows")).transform(df)) == rows(model.transform(df))
    vectors = TextVectors("id", "text", blocks={kind: None, "word": 3}, min_df=1, max_df=1.0).fit(df)
    vectors.write().save(str(tmp_path / "vectors"))
    loaded = TextVectorsModel.load(str(tmp_path / "vectors"))
    assert loaded.offsets == vectors.offsets and rows(loaded.transform(df)) == rows(vectors.transform(df))


def test_votes_and_calibration(spark, tmp_path):
    df = toy(spark).na.fill(0.0)
    data = md.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("id", "label", "features")
    for calibrator in (md.sigmoid_calibrator, md.isotonic_calibrator):
        margins = md.Calibrated("id", "label", [0, 1], md.svm_base, md.margin_score, calibrator, k=2)
        model = md.SoftVote([md.logistic(120, maxIter=5), margins], [1, 2]).fit(data)
        path = str(tmp_path / calibrator.__name__)
        PipelineModel([model]).write().save(path)
        assert rows(PipelineModel.load(path).transform(data)) == rows(model.transform(data))


def test_functions_without_a_name_cannot_be_saved(spark, tmp_path):
    model = Pipeline(stages=[ft.Step(lambda df: df.withColumn("x", F.lit(1)))]).fit(toy(spark))
    assert model.transform(toy(spark)).where("x = 1").count() == 120
    with pytest.raises(ValueError, match="cannot be saved"):
        model.write().save(str(tmp_path / "step"))


def test_publishing_shows_all_or_nothing(spark, tmp_path):
    folder, test = str(tmp_path / "out"), spark.range(6)
    good = test.select("id", (F.col("id") / 7.0).alias("p"), F.lit("x").alias("note"))
    place = submission.publish_submission(good, "id", ["p"], test, folder, "1", "a", 2)
    assert place.endswith("submission_a_seed2_1") and os.listdir(folder) == ["submission_a_seed2_1"]
    assert {(r.id, float(r.p)) for r in spark.read.csv(place, header=True, schema="id long, p string").collect()} == {(i, i / 7.0) for i in range(6)}
    bad = [good.where("id < 5"), good.union(good), good.withColumn("p", F.when(F.col("id") != 3, F.col("p")))]
    for df in bad:
        with pytest.raises(ValueError, match="invalid submission"):
            submission.publish_submission(df, "id", ["p"], test, folder, "2")
    with pytest.raises(FileExistsError):
        submission.publish_submission(good, "id", ["p"], test, folder, "1", "a", 2)
    assert os.listdir(folder) == ["submission_a_seed2_1"]
    empty = submission.publish_submission(good.limit(0), "id", ["p"], test.limit(0), folder, "3")
    assert spark.read.csv(empty, header=True, schema="id long, p double").count() == 0


def test_full_report(spark):
    """First runs by step, metrics of successful runs only, empty lists, seeds without a submission."""
    rows = [
        ("a", 1, 2, True, 0.9, 5.0, True, {"f": 0.5}), ("a", 1, 1, False, 0.2, 4.0, True, {"f": 9.0}), ("a", 2, 1, True, 0.95, 1.0, False, {"f": 1.5, "g": 2.0}),
        ("b", 7, 1, False, None, 2.0, False, None),
    ]
    runs = spark.createDataFrame(rows, "competition string, seed long, step long, success boolean, score double, runtime_seconds double, has_submission boolean, metrics map<string,double>")
    thresholds = lookups.threshold_table(spark, {"a": (0.1, 0.5, 0.8, False)})
    got = {r.competition: r for r in statistics.full_report(runs, thresholds).collect()}
    assert [tuple(x) for x in got["a"].results] == [(1, True, 0.2, "bronze"), (2, False, 0.95, "none")]
    assert [tuple(x) for x in got["a"].runs] == [(1, False, 0.2, 4.0), (2, True, 0.95, 1.0)]
    assert [(x.metric, x.n, x.mean, round(x.std_error, 9)) for x in got["a"].metrics] == [("f", 2, 1.0, 0.5), ("g", 1, 2.0, 0.0)]
    assert got["b"].metrics == [] and (got["a"].total_runs, got["a"].total_medals, got["b"].submissions) == (2, 1, 0)
    assert statistics.full_report(runs.limit(0), thresholds).count() == 0
