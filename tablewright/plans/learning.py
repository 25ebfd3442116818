"""Queries: Spark ML models.

Fitted values have no SQL twin; what SQL can state about them is checked: which ids, classes and folds there are, and that the values behind
them are sound. Quality floors are in the tests.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.operators import features as ft
from tablewright.operators import models as md
from tablewright.operators.ordered import bucket_count
from tablewright.plans.lookups import long_predictions
from tablewright.operators.vectors import TextVectors
from tablewright.plans.registry import query
from tablewright.session import checkpointed, scratch_scope, written

NUMERIC = ["chars", "words", "lines", "word_length"]


def table(t):
    """Document measures; the label says whether the document is English.

    Written once: the fits scan the measures many times, and the texts they come from only here.
    """
    return checkpointed(t.docstats.withColumn("label", (F.col("lang") == "en").cast("int")))


def table_parts(t):
    """Prepared training and scoring parts of the document measures."""
    df = table(t)
    prep = md.table_features(NUMERIC, ["source"]).fit(df.where("is_train"))
    keep = ["id", "label", "features"]
    return tuple(checkpointed(prep.transform(df.where(part)).select(keep)) for part in ("is_train", "not is_train"))


def text_parts(t):
    """(squeezed rows of the labelled documents, vectors of the unlabelled ones, what makes the vectors of squeezed rows): word and character
    TF-IDF; the label is the quality flag. Vectors are nowhere written, texts only until their terms are."""
    labelled = t.labelled.select("id", "text", F.col("target").alias("label"))
    with scratch_scope(t.spark, keep=("squeezed", "vocabulary")):
        texts = written(labelled.repartition(bucket_count(labelled)), "labelled")
        prep = TextVectors("id", "text", drop_text=True, stored=True).fit(texts)
        train = written(prep.squeezed(texts, dealt=True), "squeezed")
    return train, prep.streamed(t.unlabelled.select("id", "text")), prep.vectors


LANGS = "(SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM labelled))"


def language_parts(t):
    """(id, label, features) of labelled and unlabelled documents: word vectors, the label is the language's place in order."""
    train, test = (df.select("id", "lang", "text") for df in (t.labelled, t.unlabelled))
    codes = ft.LabelEncoder("lang", "label").fit(train)
    prep = TextVectors("id", "text", blocks={"word": fixed.WORD_TERMS}, drop_text=True).fit(train)
    keep = ["id", F.col("label").cast("double").alias("label"), "features"]
    return tuple(prep.transform(codes.transform(df)).select(keep) for df in (train, test))


def sound(probs):
    """(id, classes, sound): distinct classes of each id, and whether their probabilities lie in [0, 1] and sum to 1."""
    good = F.bool_and(F.col("p").between(0, 1)) & (F.abs(F.sum("p") - 1) < 1e-6)
    return probs.groupBy("id").agg(F.count_distinct("class").alias("classes"), good.alias("sound"))


def in_range(scored, low=0.0, high=1.0):
    """(id, sound): whether the prediction lies in the range."""
    return scored.select("id", F.col("prediction").between(low, high).alias("sound"))


UNLABELLED_SQL = "SELECT id, 2 AS classes, true AS sound FROM unlabelled"
TEST_SQL = "SELECT id, true AS sound FROM docstats WHERE NOT is_train"


@query("lr_text", UNLABELLED_SQL, ("unlabelled",))
def lr_text(t):
    train, test, vectors = text_parts(t)
    return sound(md.class_probabilities(md.logistic(train.count(), maxIter=50).fit(vectors(train)), test, "id"))


@query("gbt_tabular", TEST_SQL, ("docstats",))
def gbt_tabular(t):
    train, test = table_parts(t)
    return in_range(md.batch_score(md.boosted(2).fit(train), test, "id"))


@query("gbt_multiclass", "SELECT id, (SELECT count(DISTINCT lang) FROM docstats) AS classes, true AS sound FROM docstats WHERE NOT is_train", ("docstats",))
def gbt_multiclass(t):
    """The language from the measures, one boosted member against the rest per class."""
    df = ft.LabelEncoder("lang", "label").fit(t.docstats).transform(table(t).drop("label"))
    prep = md.table_features(NUMERIC, []).fit(df.where("is_train"))
    train, test = (checkpointed(prep.transform(df.where(p)).select("id", F.col("label").cast("double").alias("label"), "features")) for p in ("is_train", "not is_train"))
    return sound(md.class_probabilities(md.boosted(4, maxIter=3).fit(train), test, "id"))


def regression(t, model):
    df = table(t).withColumn("label", F.col("words"))
    prep = md.table_features(["chars", "lines"], ["lang"]).fit(df.where("is_train"))
    train = checkpointed(prep.transform(df.where("is_train")).select("id", "label", "features"))
    return md.batch_score(model.fit(train), prep.transform(df.where("not is_train")), "id", "regression"), train.agg(F.min("label"), F.max("label")).first()


@query("forest_regressor", TEST_SQL, ("docstats",))
def forest_regressor(t):
    """Means of training labels, so inside their range."""
    scored, (low, high) = regression(t, md.forest_regressor())
    return in_range(scored, low - 1e-6, high + 1e-6)


@query("gbt_regressor", "SELECT id, true AS sound FROM docstats WHERE NOT is_train", ("docstats",))
def gbt_regressor(t):
    """Sums of steps: within the training range widened by its own width."""
    scored, (low, high) = regression(t, md.boosted_regressor(maxIter=5))
    return in_range(scored, low - (high - low), high + (high - low))


@query("svm_calibrated", UNLABELLED_SQL, ("unlabelled",))
def svm_calibrated(t):
    train, test, vectors = text_parts(t)
    return sound(md.calibrated(train, test, "id", "label", md.svm_base, md.margin_score, md.sigmoid_calibrator, [0, 1], prepare=vectors))


@query("isotonic_calibrated", "SELECT id, 2 AS classes, true AS sound FROM docstats WHERE NOT is_train", ("docstats",))
def isotonic_calibrated(t):
    train, test = table_parts(t)
    return sound(md.calibrated(train, test, "id", "label", md.boosted_base, md.probability_score, md.isotonic_calibrator, [0, 1]))


@query("soft_vote", """SELECT id, 1 AS class, round((p + least(x / 40000.0::double, 1)) / 2, 12) AS p FROM scored
    UNION ALL SELECT id, 0, round((1 - p + 1 - least(x / 40000.0::double, 1)) / 2, 12) FROM scored""", ("scored",))
def soft_vote(t):
    c = F.col

    def member(model):
        p = F.least(c("score"), F.lit(1.0))
        both = F.array(F.struct(F.lit(1).alias("class"), p.alias("p")), F.struct(F.lit(0).alias("class"), (1 - p).alias("p")))
        return long_predictions(t).where(c("model") == model).select("id", F.inline(both))

    return md.soft_vote([member("logistic"), member("length")]).withColumn("p", F.round("p", 12))


@query("model_search", "SELECT unnest(['boosted', 'forest', 'logistic']) AS model, true AS sound")
def model_search(t):
    train, _ = table_parts(t)
    families = {"boosted": md.boosted(2, maxIter=5), "forest": md.forest(2, numTrees=10), "logistic": md.logistic(train.count(), maxIter=20)}
    board = md.model_search(train, "id", "label", families, 3)
    return board.select("model", (F.col("auc").between(0, 1) & F.col("place").between(1, 3)).alias("sound"))


@query("oof_predict", """SELECT id, CAST(lang = 'en' AS INTEGER) AS label,
    CAST(row_number() OVER (PARTITION BY lang = 'en' ORDER BY md5(concat(id, ':42')), id) % 5 AS INTEGER) AS fold, true AS sound FROM docstats WHERE is_train""", ("docstats",))
def oof_predict(t):
    train, _ = table_parts(t)
    oof = md.oof_predict(train, "id", "label", md.forest(2, numTrees=10), 5)
    return oof.select("id", "label", "fold", F.col("prediction").between(0, 1).alias("sound"))


@query("batch_score", "SELECT id, true AS sound FROM unlabelled", ("unlabelled",))
def batch_score(t):
    train, test, vectors = text_parts(t)
    return in_range(md.batch_score(md.logistic(train.count(), maxIter=30).fit(vectors(train)), test, "id"))


@query("select_features", "SELECT concat('poly_', i) AS feature, true AS sound, true AS whole FROM range(20) r(i)")
def select_features(t):
    base = ["chars", "words", "lines", "word_length", "source_code"]
    measures = table(t)
    df = ft.LabelEncoder("source").fit(measures).transform(measures)
    wide = ft.poly2(df, base)
    found = md.select_features(wide, [c for c in wide.columns if c.startswith("poly_")], "label")
    whole = F.abs(F.sum("importance").over(W.partitionBy(F.lit(1))) - 1) < 1e-6  # twenty rows
    return found.select("feature", F.col("importance").between(0, 1).alias("sound"), whole.alias("whole"))


NAMED_SQL = f"SELECT u.lang, count(*) AS n, true AS known FROM unlabelled u JOIN {LANGS} k USING (lang) GROUP BY 1"


def named(scored, truth):
    """(lang, n, known): whether more than half of a language's documents are named right, which a constant model does for one at most."""
    right = F.avg((F.col("prediction") == F.col("label")).cast("double")) > 0.5
    return scored.join(truth, "id").groupBy("lang").agg(F.count("*").alias("n"), right.alias("known"))


def truth(t, test):
    return t.unlabelled.select("id", "lang").join(test.select("id", "label"), "id")


@query("batch_score_multiclass", NAMED_SQL, ("labelled", "unlabelled"))
def batch_score_multiclass(t):
    """The language of every unlabelled document by a model of the labelled ones' words; a constant model names one language."""
    train, test = language_parts(t)
    return named(md.batch_score(md.logistic(train.count(), maxIter=30).fit(train), test, "id", "multiclass"), truth(t, test))


@query("vote_fitted", NAMED_SQL, ("labelled", "unlabelled"))
def vote_fitted(t):
    """Three members fitted on one feature table vote on the language: logistic regression, a forest and calibrated margins."""
    train, test = language_parts(t)
    classes = [r[0] for r in train.select("label").distinct().collect()]  # the languages
    margins = md.Calibrated("id", "label", classes, md.svm_base, md.margin_score, md.sigmoid_calibrator)
    vote = md.SoftVote([md.logistic(train.count(), maxIter=30), md.forest(len(classes)), margins])
    return named(md.batch_score(vote.fit(train), test, "id", "multiclass"), truth(t, test))


@query("calibrated_classes", f"""SELECT part, k.lang, count(*) AS n, true AS sound, true AS likely FROM
      (SELECT 'labelled' AS part, lang FROM labelled UNION ALL SELECT 'unlabelled', lang FROM unlabelled) d JOIN {LANGS} k USING (lang) GROUP BY 1, 2""", ("labelled", "unlabelled"))
def calibrated_classes(t):
    """One fitted model scores two tables: per table and language, whether probabilities are sound, and whether the true language has
    on average more than half of them."""
    train, test = language_parts(t)
    classes = sorted(r[0] for r in train.select("label").distinct().collect())  # the languages
    model = md.Calibrated("id", "label", classes, md.svm_base, md.margin_score, md.isotonic_calibrator).fit(train)
    names = t.labelled.select("lang").distinct()
    codes = ft.LabelEncoder("lang", "label").fit(names).transform(names).select("lang", F.col("label").cast("double").alias("label"))

    def rows(part, df):
        scored = model.transform(df).join(codes, "label")
        scored = scored.withColumn("p", md.probability_array(scored))
        sum_one = F.abs(F.aggregate("p", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9
        good = F.bool_and(sum_one & (F.array_min("p") >= 0) & (F.size("p") == len(classes)))
        own = F.avg(F.element_at("p", (F.col("label") + 1).cast("int"))) > 0.5
        return scored.groupBy("lang").agg(F.count("*").alias("n"), good.alias("sound"), own.alias("likely")).withColumn("part", F.lit(part))

    return md.stacked([rows("labelled", train), rows("unlabelled", test)])


@query("lr_text_quality", "SELECT target AS label, count(*) AS n, true AS above FROM labelled GROUP BY 1", ("labelled",))
def lr_text_quality(t):
    """Per label, whether the out-of-fold scores of the stacked vectors rank it better than a constant score would (AUC 0.5)."""
    train, _, vectors = text_parts(t)
    oof = checkpointed(md.oof_predict(train, "id", "label", md.logistic(train.count(), maxIter=30), 3, prepare=vectors))
    auc = md.task_metric(oof, "label", "binary").first()["auc"]
    return oof.groupBy("label").agg(F.count("*").alias("n")).withColumn("above", F.lit(auc > 0.55))


@query("search_multiclass", "SELECT unnest(['forest', 'logistic']) AS model, true AS informed")
def search_multiclass(t):
    """Out-of-fold log loss of the language against that of the classes' shares."""
    train, _ = language_parts(t)
    families = {"forest": md.forest(train.select("label").distinct().count(), numTrees=10), "logistic": md.logistic(train.count(), maxIter=20)}
    board = md.model_search(train, "id", "label", families, 3, "multiclass")
    share = train.groupBy("label").count().withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy(F.lit(1))))  # a row per class
    blind = share.agg(F.sum(-F.col("p") * F.log("p"))).first()[0]
    return board.select("model", (F.col("log_loss") < blind).alias("informed"))


@query("search_regression", "SELECT unnest(['boosted', 'forest']) AS model, true AS informed")
def search_regression(t):
    """Out-of-fold r2 of the number of words."""
    df = table(t).where("is_train").withColumn("label", F.col("words"))
    train = checkpointed(md.table_features(["chars", "lines"], ["lang"]).fit(df).transform(df).select("id", "label", "features"))
    board = md.model_search(train, "id", "label", {"boosted": md.boosted_regressor(maxIter=5), "forest": md.forest_regressor(numTrees=10)}, 3, "regression")
    return board.select("model", (F.col("r2") > 0.5).alias("informed"))
