"""Spark ML models on prepared features: text and table pipelines, calibration, voting, search."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright import fixed
from tablewright.functions.arrays import let
from tablewright.operators import features as ft
from tablewright.operators import metrics
from tablewright.operators.ordered import bucket_count
from tablewright.operators.sampling import kfold_stratified
from tablewright.operators.saved import Fitted
from tablewright.operators.text import word_grams, word_tokens
from tablewright.session import checkpointed, written


def stacked(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def with_grams(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_grams", word_grams(word_tokens(F.coalesce(F.col(text), F.lit("")))))


def without(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)


def text_features(text: str, terms: int = fixed.WORD_TERMS) -> Pipeline:
    """Word 1-3-grams -> counts -> idf -> unit length, all on the JVM side. ``vectors.TextVectors`` has the weights of TfIdf, any blocks and no limit."""
    grams = ft.Step(with_grams, text=text)
    count = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=terms, minDF=fixed.MIN_DF, maxDF=fixed.MAX_DF)
    return Pipeline(stages=[
        grams, count, IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="features"),
        ft.Step(without, columns=["_grams", "_tf", "_tfidf"]),
    ])


def table_features(numeric, categorical) -> Pipeline:
    """Interactions, imputation, codes, degree-2 products and robust scaling into one vector."""
    codes = [f"{c}_code" for c in categorical]
    base = [*numeric, *codes]
    poly = [f"poly_{i}" for i in range(len(base) + len(base) * (len(base) + 1) // 2)]
    stages = [ft.MedianImputer(numeric), ft.Interactions(numeric)]
    if categorical:
        stages.append(ft.ModeImputer(categorical))
    stages += [ft.LabelEncoder(c) for c in categorical]
    stages += [ft.Step(ft.poly2, cols=base), ft.RobustScaler(poly), VectorAssembler(inputCols=poly, outputCol="features")]
    return Pipeline(stages=stages)


def logistic(n: int, c: float = 4.0, **kw) -> LogisticRegression:
    """L2 logistic regression whose penalty equals 1 / (C n)."""
    return LogisticRegression(family="multinomial", regParam=1.0 / (c * n), standardization=False, **kw)


def boosted(classes: int, **kw):
    base = GBTClassifier(maxIter=kw.pop("maxIter", 10), seed=42, **kw)
    return base if classes == 2 else OneVsRest(classifier=base)


TREE_BYTES = 128 << 20


def dealt_for_trees(df: DataFrame, features: str) -> DataFrame:
    """``df`` in as many partitions as hold ``TREE_BYTES`` each: a forest keeps every row as one integer per feature, however sparse it is."""
    first = df.select(features).first()
    parts = 0 if first is None else -(-df.count() * first[0].size * 4 // TREE_BYTES)
    return df.repartition(max(parts, bucket_count(df))) if parts > 1 else df


class Forest(RandomForestClassifier):
    """A forest whose tasks read bounded parts of its table."""

    def _fit(self, dataset):
        return super()._fit(dealt_for_trees(dataset, self.getFeaturesCol()))


def forest(classes: int, **kw) -> RandomForestClassifier:
    return Forest(numTrees=kw.pop("numTrees", 20), seed=42, **kw)


def boosted_regressor(**kw) -> GBTRegressor:
    return GBTRegressor(maxIter=kw.pop("maxIter", 10), seed=42, **kw)


def forest_regressor(**kw) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=kw.pop("numTrees", 20), seed=42, **kw)


def batch_score(model, df: DataFrame, key: str, task: str = "binary") -> DataFrame:
    """(key, prediction): probability of class 1, predicted class or predicted value."""
    out = model.transform(df)
    if task == "binary":
        return out.select(key, vector_to_array("probability")[1].alias("prediction"))
    return out.select(key, F.col("prediction").cast("int" if task == "multiclass" else "double").alias("prediction"))


def shares(values):
    """An array scaled to sum 1; equal shares if all are zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    part = lambda s: F.transform(s["v"], lambda v: F.when(s["t"] > 0, v / s["t"]).otherwise(1.0 / F.size(s["v"])))
    return let(lambda o: let(part, v=o["v"], t=total(o["v"])), v=values)


def probability_array(out: DataFrame):
    """Class probabilities of a transformed frame. One-against-rest members give margins: their probabilities are scaled to sum 1."""
    if "probability" in out.columns:
        return vector_to_array("probability")
    return shares(F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m))))


def class_probabilities(model, df: DataFrame, key: str) -> DataFrame:
    """(key, class, p) in long form; the class is its place in the model's probabilities."""
    out = model.transform(df)
    return out.select(key, F.posexplode(probability_array(out)).alias("class", "p"))


def alongside(model, df: DataFrame, found, name: str) -> DataFrame:
    """``df`` and one column ``name``, read by ``found`` from the model's transformed frame; the model's own columns leave."""
    out = model.transform(df)
    return out.select(*map(F.col, df.columns), found(out).alias(name))


def largest(p):
    """Place of the largest value of an array, the first on ties."""
    return F.array_position(p, F.array_max(p)) - 1


def soft_vote(parts) -> DataFrame:
    """Average probability per id and class over the members' (id, class, p) tables."""
    return stacked(parts).groupBy("id", "class").agg(F.avg("p").alias("p"))


def in_threads(spark, fn, items, threads: int = 4) -> list:
    """Independent fits submitted side by side; Spark schedules their jobs."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), list(items))


class SoftVote(Estimator):
    """Average of the class probabilities of members that are fitted side by side on one feature table.

    Members are estimators whose models give ``probability``, or ``rawPrediction`` as one-against-rest does, over the same classes 0, 1, ...;
    ``weights`` default to equal ones.
    """

    def __init__(self, members, weights=None, threads: int = 4):
        super().__init__()
        self.members, self.threads = list(members), threads
        self.weights = [1.0] * len(self.members) if weights is None else list(weights)

    def _fit(self, df):
        models = in_threads(df.sparkSession, lambda e: e.copy().fit(df), self.members, self.threads)
        return SoftVoteModel({"weights": self.weights}, stages={f"member{i}": m for i, m in enumerate(models)})


class SoftVoteModel(Fitted):
    """Adds ``probability`` (vector) and ``prediction`` (class)."""

    def keep(self, *parts, **more):
        super().keep(*parts, **more)
        self.models, self.weights = list(self.stages.values()), self.stats["weights"]

    def _transform(self, df):
        out, names = df, [f"_vote{i}" for i in range(len(self.models))]
        for model, name in zip(self.models, names):
            out = alongside(model, out, probability_array, name)
        whole = sum(self.weights)

        def weighted(name, share):
            return F.transform(F.col(name), lambda v: v * share)

        votes = [weighted(n, w / whole) for n, w in zip(names, self.weights)]
        p = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), votes)
        out = out.withColumn("_p", p).drop(*names)
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": largest(F.col("_p")).cast("double")}).drop("_p")


#: task: (metric of the leaderboard, larger is better)
SEARCH_METRIC = {"binary": ("auc", True), "multiclass": ("log_loss", False), "regression": ("r2", True)}


def task_scores(model, df: DataFrame, task: str) -> DataFrame:
    """``df`` with ``prediction``: probability of class 1, array of class probabilities or predicted value."""
    found = {
        "binary": lambda out: probability_array(out)[1],
        "multiclass": probability_array,
        "regression": lambda out: F.col("prediction").cast("double"),
    }[task]
    return alongside(model, df, found, "_found").withColumnRenamed("_found", "prediction")


FIT_BYTES = 64 << 20


def side_by_side(df: DataFrame, threads: int) -> int:
    """How many fits at once on a written table of squeezed rows: each keeps vectors of many times the table's bytes."""
    hadoop, size = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(hadoop).getFileStatus(path).getLen()
    return max(1, min(threads, FIT_BYTES // max(size, 1)))


def oof_predict(df: DataFrame, key: str, label: str, estimator, k: int = 5, seed: int = 42, task: str = "binary", prepare=None) -> DataFrame:
    """(key, label, fold, prediction): every row scored by the model of the other folds, as ``task_scores`` says.

    Folds are even within each class; for regression within all rows. ``prepare`` makes the features of any part of ``df`` that the estimator
    reads; they are not kept.
    """
    if task == "regression":
        folds = kfold_stratified(df.withColumn("_all", F.lit(0)), key, "_all", k, seed).drop("_all")
    else:
        folds = kfold_stratified(df, key, label, k, seed)
    folds, made = (written(folds, "fold-rows"), prepare) if prepare else (checkpointed(folds), lambda part: part)

    def one(i):
        model = estimator.copy().fit(made(folds.where(F.col("fold") != i)))
        return task_scores(model, made(folds.where(F.col("fold") == i)), task).select(key, label, "fold", "prediction")

    return stacked(in_threads(df.sparkSession, one, range(k), side_by_side(folds, 4) if prepare else 4))


def task_metric(scored: DataFrame, label: str, task: str) -> DataFrame:
    """One row with the metric of SEARCH_METRIC; null if a row lacks its prediction or label."""
    if task == "binary":
        return metrics.auc(scored, label, ["prediction"]).select("auc")
    if task == "multiclass":
        return scored.agg(metrics.multi_log_loss(F.col("prediction"), F.col(label)).alias("log_loss"))
    return scored.agg(metrics.r2(F.col(label), F.col("prediction")).alias("r2"))


def model_search(df: DataFrame, key: str, label: str, families: dict, k: int = 5, task: str = "binary") -> DataFrame:
    """Leaderboard (model, metric, place) of several families by the task's exact metric over out-of-fold scores."""
    name, larger = SEARCH_METRIC[task]
    parts = [
        task_metric(oof_predict(df, key, label, est, k, task=task), label, task).select(F.lit(family).alias("model"), name)
        for family, est in families.items()
    ]
    board = stacked(parts)  # one row per family
    return board.withColumn("place", F.rank().over(W.orderBy(F.desc_nulls_last(name) if larger else F.asc_nulls_last(name))))


class Calibrated(Estimator):
    """Probabilities of ``classes`` from members that give scores only, calibrated by cross-validation.

    Per class and fold, ``base()`` learns from the other folds whether a row (column ``_y``) is of the class, and ``calibrator`` maps its
    ``score`` on the fold to a probability. With two classes only the larger one is learned. ``df`` needs key, label and features, or what
    ``prepare`` makes the features of.
    """

    def __init__(self, key, label, classes, base, score, calibrator, k: int = 3, seed: int = 42, threads: int = 4, prepare=None):
        super().__init__()
        self.prepare = prepare
        self.key, self.label, self.classes, self.base, self.score = key, label, sorted(classes), base, score
        self.calibrator, self.k, self.seed, self.threads = calibrator, k, seed, threads

    def _fit(self, df):
        if self.prepare:
            folds, made = written(kfold_stratified(df, self.key, self.label, self.k, self.seed), "fold-rows"), self.prepare
            threads = side_by_side(folds, self.threads)
        else:
            folds = checkpointed(kfold_stratified(df.select(self.key, self.label, "features"), self.key, self.label, self.k, self.seed))
            made, threads = lambda part: part, self.threads
        wanted = self.classes if len(self.classes) > 2 else self.classes[1:]

        def one(job):
            cls, i = job
            data = folds.withColumn("_y", (F.col(self.label) == cls).cast("double"))
            model = self.base().fit(made(data.where(F.col("fold") != i)))
            held = self.score(model.transform(made(data.where(F.col("fold") == i)))).select(F.col("_y").alias("y"), "score")
            return model, self.calibrator(held)

        jobs = [(cls, i) for cls in wanted for i in range(self.k)]
        fitted = in_threads(df.sparkSession, one, jobs, threads)
        stages = {}
        for (cls, i), (model, to_p) in zip(jobs, fitted):
            stages |= {f"model{wanted.index(cls)}_{i}": model, f"calibrator{wanted.index(cls)}_{i}": to_p}
        return CalibratedModel({"classes": self.classes, "learned": len(wanted), "folds": self.k}, stages=stages, functions={"score": self.score})


class CalibratedModel(Fitted):
    """Adds ``probability`` (vector, in order of ``classes``) and ``prediction`` (the likeliest class) to any table with features.

    ``members`` holds, per learned class, (model, calibrator) of each fold. A class's probability is the folds' mean, scaled to sum 1.
    """

    def keep(self, *parts, **more):
        super().keep(*parts, **more)
        self.classes, self.score, learned, folds = self.stats["classes"], self.functions["score"], self.stats["learned"], self.stats["folds"]
        self.members = [[(self.stages[f"model{c}_{i}"], self.stages[f"calibrator{c}_{i}"]) for i in range(folds)] for c in range(learned)]

    def _transform(self, df):
        out, per = df, []
        for c, folds in enumerate(self.members):
            names = [f"_p{c}_{i}" for i in range(len(folds))]
            for (model, to_p), name in zip(folds, names):
                scored = self.score(model.transform(out)).select(*out.columns, "score")
                out = to_p.transform(scored).withColumnRenamed("p", name).drop("score")
            per.append(reduce(lambda a, b: a + b, map(F.col, names)) / len(names))
        p = shares(F.array(*per)) if len(self.classes) > 2 else let(lambda s: F.array(1 - s["p"], s["p"]), p=per[0])
        out = out.withColumn("_p", p).select(*[F.col(c) for c in df.columns], "_p")
        place = F.array(*[F.lit(float(c)) for c in self.classes])
        likeliest = F.element_at(place, (largest(F.col("_p")) + 1).cast("int"))
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": likeliest}).drop("_p")


def calibrated(train: DataFrame, test: DataFrame, key: str, label: str, base, score, calibrator, classes, k: int = 3, prepare=None) -> DataFrame:
    """(key, class, p) of ``test`` by a ``Calibrated`` model of ``train``."""
    model = Calibrated(key, label, classes, base, score, calibrator, k, prepare=prepare).fit(train)
    names = F.array(*[F.lit(c) for c in model.classes])
    return class_probabilities(model, test, key).select(key, names[F.col("class")].alias("class"), "p")


def sigmoid_calibrator(held: DataFrame):
    """Platt scaling: logistic regression on the score alone; a calibrator is a model that adds ``p``."""
    vec = VectorAssembler(inputCols=["score"], outputCol="features")
    model = LogisticRegression(labelCol="y").fit(vec.transform(held))
    return SigmoidModel({"slope": float(model.coefficients[0]), "at": float(model.intercept)})


class SigmoidModel(Fitted):
    def _transform(self, df):
        return df.withColumn("p", 1 / (1 + F.exp(-(F.col("score") * self.stats["slope"] + self.stats["at"]))))


def isotonic_calibrator(held: DataFrame):
    return IsotonicModel(stages={"steps": IsotonicRegression(featuresCol="score", labelCol="y", predictionCol="p").fit(held)})


class IsotonicModel(Fitted):
    def _transform(self, df):
        return self.stages["steps"].transform(df).withColumn("p", F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)))


def svm_base():
    return LinearSVC(labelCol="_y", maxIter=50, regParam=0.01)


def boosted_base():
    return GBTClassifier(labelCol="_y", maxIter=5, seed=42)


def margin_score(out: DataFrame) -> DataFrame:
    return out.withColumn("score", vector_to_array("rawPrediction")[1])


def probability_score(out: DataFrame) -> DataFrame:
    return out.withColumn("score", vector_to_array("probability")[1])


def select_features(df: DataFrame, columns, label: str, keep: int = 20) -> DataFrame:
    """(feature, importance): forest importances, the ``keep`` largest when there are more columns."""
    vec = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    weights = forest(2, labelCol=label).fit(vec).featureImportances.toArray().tolist()
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("importance")) for c, w in zip(columns, weights)])
    table = df.sparkSession.range(1).select(F.inline(pairs))
    return table.orderBy(F.desc("importance"), "feature").limit(keep)
