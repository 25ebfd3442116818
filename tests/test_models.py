"""Quality floors and shapes of the model queries."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright import session
from tablewright.operators import metrics
from tablewright.operators import models as md
from tablewright.operators import vectors
from tablewright.plans import learning
from tablewright.sources.views import Tables

NUMERIC = ["a", "b"]


def toy(spark, n=240):
    a, b = (F.col("id") * 37 % 101) / 101.0, (F.col("id") * 53 % 89) / 89.0
    df = spark.range(n).select("id", a.alias("a"), b.alias("b"))
    return df.withColumn("label", (F.col("a") + F.col("b") > 1).cast("int"))


def test_table_pipeline_and_calibration(spark):
    df = toy(spark)
    prep = md.table_features(NUMERIC, []).fit(df)
    data = prep.transform(df).select("id", "label", "features")
    oof = md.oof_predict(data, "id", "label", md.forest(2, numTrees=5), 3)
    assert oof.count() == 240 and metrics.auc(oof, "label", ["prediction"]).first()["auc"] > 0.9
    probs = md.calibrated(data, data, "id", "label", md.svm_base, md.margin_score, md.sigmoid_calibrator, [0, 1])
    total = probs.groupBy("id").agg(F.sum("p").alias("s"))
    assert total.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    scored = probs.where("class = 1").join(df, "id")
    assert metrics.auc(scored, "label", ["p"]).first()["auc"] > 0.9


def test_text_pipeline(spark):
    rows = [(i, "good fine nice word" if i % 2 else "bad poor ugly word") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("label", (F.col("id") % 2).cast("int"))
    data = md.text_features("text").fit(df).transform(df)
    scores = md.batch_score(md.logistic(40, maxIter=20).fit(data), data, "id").join(df, "id")
    assert metrics.auc(scores, "label", ["prediction"]).first()["auc"] == 1.0


def three(spark, n=300):
    """Three classes along the first of two features."""
    df = toy(spark, n).withColumn("label", F.floor(F.col("a") * 3).cast("double"))
    prep = md.table_features(NUMERIC, []).fit(df)
    return prep.transform(df).select("id", "label", "features")


def test_calibrated_model_scores_later_tables(spark):
    data = three(spark).cache()
    for base, score, to_p in ((md.svm_base, md.margin_score, md.sigmoid_calibrator), (md.boosted_base, md.probability_score, md.isotonic_calibrator)):
        model = md.Calibrated("id", "label", [2.0, 0.0, 1.0], base, score, to_p, k=2).fit(data.where("id % 3 > 0"))
        for part in (data.where("id % 3 > 0"), data.where("id % 3 = 0"), data.where("id < 0")):
            out = model.transform(part)
            assert out.columns == ["id", "label", "features", "probability", "prediction"] and out.count() == part.count()
            p = out.select(md.vector_to_array("probability").alias("p"), "label", "prediction").collect()
            assert all(abs(sum(r.p) - 1) < 1e-9 and min(r.p) >= 0 and r.prediction == float(r.p.index(max(r.p))) for r in p)
        scored = model.transform(data.where("id % 3 = 0"))
        # outer classes are separable by one against the rest, a line cannot cut out the middle one
        hits = scored.where("label <> 1").agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        assert hits > 0.9
    assert set(md.calibrated(data, data, "id", "label", md.boosted_base, md.probability_score, md.isotonic_calibrator, [0, 1, 2], 2).select("class").distinct().toPandas()["class"]) == {0, 1, 2}


def test_vote_is_the_members_mean(spark):
    data = three(spark).cache()
    members = [md.forest(3, numTrees=4), md.logistic(300, maxIter=10), md.boosted(3, maxIter=2)]
    vote = md.SoftVote(members, weights=[1, 2, 1]).fit(data)
    got = {r["id"]: list(r["probability"]) for r in vote.transform(data).collect()}
    want = {i: [0.0] * 3 for i in got}
    for model, w in zip(vote.models, (1, 2, 1)):
        for r in md.class_probabilities(model, data, "id").collect():
            want[r["id"]][r["class"]] += r["p"] * w / 4
    assert all(abs(a - b) < 1e-12 for i in got for a, b in zip(got[i], want[i]))
    # three ways to average must not lose rows, nor keep the members' columns
    assert vote.transform(data).columns == ["id", "label", "features", "probability", "prediction"] and len(got) == 300


def test_search_takes_the_metric_of_the_task(spark):
    data = three(spark).cache()
    constant = md.logistic(300, c=1e-12, maxIter=5)
    board = md.model_search(data, "id", "label", {"none": constant, "forest": md.forest(3, numTrees=5)}, 3, "multiclass").collect()
    assert {r["model"]: r["place"] for r in board} == {"forest": 1, "none": 2}
    assert abs({r["model"]: r["log_loss"] for r in board}["none"] - 1.0986) < 0.01
    values = data.withColumn("label", F.col("id").cast("double") * 37 % 101)
    board = md.model_search(values, "id", "label", {"forest": md.forest_regressor(), "stump": md.forest_regressor(numTrees=1, maxDepth=1)}, 3, "regression").collect()
    r2 = {r["model"]: r["r2"] for r in board}
    assert r2["forest"] > 0.95 > r2["stump"]
    oof = md.oof_predict(values, "id", "label", md.forest_regressor(numTrees=2), 3, task="regression")
    assert sorted(r["count"] for r in oof.groupBy("fold").count().collect()) == [100, 100, 100]


def test_vectors_hold_the_rows(spark):
    rows = [(1, "good fine nice word", "a"), (2, "bad poor ugly word", "b"), (3, None, "c"), (4, "", "d"), (5, "zzz", "e"), (6, "word good bad", "f")]
    df = spark.createDataFrame(rows, "id long, text string, features_of string")
    model = vectors.TextVectors("id", "text", max_df=1.0).fit(df)
    got = {r["id"]: r["features"] for r in model.transform(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[3].numNonzeros() == got[4].numNonzeros() == got[5].numNonzeros() == 0
    want = {}
    for m, at in zip(model.models, model.offsets):
        codes = {r["term"]: r["code"] for r in m.vocabulary.collect()}
        assert sorted(codes.values()) == list(range(len(codes))) and [t for t, _ in sorted(codes.items(), key=lambda p: p[1])] == sorted(codes)
        for r in m.transform(df).collect():
            want[r["id"], codes[r["term"]] + at] = r["weight"]
    assert {(i, int(j)): float(v.values[n]) for i, v in got.items() for n, j in enumerate(v.indices)} == want
    assert all(v.size == model.size for v in got.values())
    # words that the fit has not met are opened by transform, and an empty table gives no rows
    new = spark.createDataFrame([(9, "wordy goodness")], "id long, text string")
    assert model.transform(new).first()["features"].numNonzeros() > 0 and model.transform(new.where("id < 0")).count() == 0


def test_a_forest_reads_bounded_parts(spark, monkeypatch):
    """A forest keeps a sparse row as one integer per feature: parts follow from rows and width, not from the files."""
    monkeypatch.setattr(md, "TREE_BYTES", 4000)
    rows = [(i, float(i % 2), Vectors.sparse(100, {i % 2: 1.0, 50 + i % 50: 1.0})) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "label", "features"]).coalesce(1)
    dealt = md.dealt_for_trees(df, "features")
    sizes = dealt.rdd.glom().map(len).collect()
    assert len(sizes) == 20 and max(sizes) <= 20
    seen = []
    monkeypatch.setattr(md.RandomForestClassifier, "_fit", lambda self, data, fit=md.RandomForestClassifier._fit: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    model = md.forest(2, numTrees=3).copy().fit(df)
    assert seen == [20] and model.transform(df).where("prediction = label").count() == 200
    assert md.dealt_for_trees(df.where("id < 0"), "features").count() == 0


def test_vectors_come_without_a_join(spark):
    """Wide vectors are written beside their rows: repeated keys share theirs, null keys have none, texts leave if wanted."""
    df = spark.createDataFrame([(1, "one two", 5), (1, "two three", 6), (2, None, 7), (None, "one two", 8)], "id long, text string, x int")
    model = vectors.TextVectors("id", "text", blocks={"word": 10}, min_df=1, max_df=1.0, drop_text=True).fit(df)
    out = model.transform(df)
    assert out.columns == ["id", "x", "features"] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["x"]: r["features"] for r in out.collect()}
    assert set(got) == {5, 6, 7} and got[5] == got[6] and got[5].numNonzeros() == 5 and got[7].numNonzeros() == 0


TEXTS = [(i % 50 if i < 52 else None, " ".join(f"{w}{'abcdefgh'[(i * j) % 8]}" for j, w in enumerate(["mill", "öre", "shore"] * (i % 9)))) for i in range(54)]


def test_squeezed_terms_are_the_vectors(spark, monkeypatch):
    """Vectors that are written, made on the way, and made again of squeezed terms are the same to the last bit, also with repeated and null keys."""
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate([*TEXTS, (90, None), (91, "mill " * 300)])], "id long, text string, n int")
    model = vectors.TextVectors("id", "text", blocks={"word": 30, "char": 50}, min_df=1, max_df=1.0, drop_text=True).fit(df)
    want = {r["n"]: r["features"] for r in model.transform(df).collect()}
    monkeypatch.setattr(vectors, "read_vectors", None)
    squeezed = model.squeezed(df)
    again = model.vectors(squeezed.withColumn("more", F.col("n") + 1))
    assert again.columns == ["id", "n", "more", "features"] and len(want) == 54
    for out in (model.streamed(df), again):
        assert {r["n"]: r["features"] for r in out.collect()} == want
    assert {r["n"] for r in again.where("more > n").collect()} == set(want)


@pytest.fixture(scope="module")
def labelled_texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    rows = [(i, f"{'fine good calm' if i % 2 else 'poor bad loud'} {TEXTS[i % 50][1]}", "en", "s", 20) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", ["lr_text", "batch_score", "svm_calibrated", "lr_text_quality"])
def test_text_models_write_no_vectors(spark, labelled_texts, monkeypatch, name):
    """Vectors are many times as large as texts: none is written, and texts and counts go when the vocabularies are there."""
    asked, scratch = [], session.scratch
    monkeypatch.setattr(session, "scratch", lambda s, kind: asked.append(kind) or scratch(s, kind))
    monkeypatch.setattr(vectors, "read_vectors", None)
    before = len(session._MADE)
    rows = getattr(learning, name)(Tables(spark, labelled_texts)).collect()
    left = {m.rpartition("/")[2].rpartition("-")[0] for m in session._MADE[before:]}
    assert "texts" in asked and not left & {"texts", "labelled", "words", "runs", "totals", "candidates"} and {"squeezed", "vocabulary"} <= left
    if name == "lr_text_quality":
        assert {(r["label"], r["n"], r["above"]) for r in rows} == {(0, 30, True), (1, 30, True)}
    else:
        assert {r["id"] for r in rows} == set(range(60, 90)) and all(r["sound"] for r in rows)


@pytest.mark.parametrize("size, threads", [(100, 4), (3000, 1)])
def test_large_fits_wait_for_each_other(spark, tmp_path, monkeypatch, size, threads):
    monkeypatch.setattr(md, "FIT_BYTES", 20_000)
    spark.range(size).coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "t"))
    assert md.side_by_side(spark.read.parquet(str(tmp_path / "t")), 4) == threads
