"""Hand-computed tables for profiles, features, submissions, logs, files, arrays."""

import math
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import fixed
from tablewright.functions import arrays, logtext, numbers, strings
from tablewright.operators import columns, features, files, lookups, metrics, profiling, roles, signals, statistics, submission, termcodes, text
from tablewright.sources import readers, writers


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# ---- sources ----------------------------------------------------------------------------------------------
def test_csv_missing_texts_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,s,e,b\n1,NA,"a ""q"", b",,True\n2,2.5,null,NaN,false\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "double", "boolean"]
    assert [tuple(r) for r in df.collect()] == [(1, None, 'a "q", b', None, True), (2, 2.5, None, None, False)]


def test_csv_safe_gives_an_empty_table(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    df = readers.read_csv_safe(spark, str(tmp_path / "none.csv"), schema)
    assert df.count() == 0 and df.columns == ["id"]


def test_json_array_file_and_listing(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"seed": 1, "ok": true}, {"seed": 2, "ok": false}]')
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "x.jpg").write_bytes(b"123")
    assert readers.read_json_rows(spark, str(tmp_path / "r.json"), "seed long, ok boolean", array_file=True).count() == 2
    got = readers.list_files(spark, str(tmp_path), "*.jpg").collect()
    assert len(got) == 1 and got[0]["length"] == 3


def test_submission_name():
    assert writers.submission_name("20240101_000000") == "submission_20240101_000000"
    assert writers.submission_name("s", "x", 1) == "submission_x_seed1_s"


def test_layout_precedence(spark):
    paths = ["train.csv", "train/a.csv", "train/z.csv", "test/t.csv", "train_images/1.JPG", "submission.csv", "info.json"]
    df = spark.createDataFrame([("d", p) for p in paths] + [("e", "training.csv"), ("e", "train_data.csv"), ("f", "x.txt")], "dataset string, path string")
    got = {r["dataset"]: r for r in files.dataset_layout(df).collect()}
    assert got["d"]["train_csv"] == "train/a.csv" and got["d"]["structure_type"] == "image_dataset"
    assert got["d"]["sample_submission"] == "submission.csv" and got["d"]["metadata_file"] == "info.json"
    assert got["e"]["train_csv"] == "training.csv" and got["e"]["structure_type"] == "flat_csv"
    assert got["f"]["structure_type"] == "unknown"
    health = {r["dataset"]: r["issues"] for r in roles.dataset_health(files.dataset_layout(df).withColumns({"train_rows": F.lit(0), "test_rows": F.lit(1)})).collect()}
    assert "Train data is empty" in health["d"] and "No training data found" in health["f"]


# ---- roles and profile ------------------------------------------------------------------------------------
def test_roles():
    assert roles.id_column(["a", "Row_ID"]) == "Row_ID"
    assert roles.id_column(["a", "k"], ["k", "p"]) == "k" and roles.id_column(["a", "b"]) == "a"
    assert roles.target_column(["id", "Rating", "z"]) == "Rating"
    assert roles.target_column(["id", "p", "z"], ["id", "p"]) == "p" and roles.target_column(["id", "z"]) == "z"
    assert roles.submission_id_column(["x", "clip"]) == "clip"


@pytest.mark.parametrize("columns_, row, want", [
    ("clip string, label int", ("a", 1), "audio"), ("image string, label int", ("x", 1), "image"),
    ("review string, date string", ("x", "y"), "multimodal"), ("before string, after string", ("x", "y"), "seq2seq"),
    ("date string, v double", ("x", 1.0), "time_series"), ("a string, v double", ("s.WAV", 1.0), "audio"), ("a long, v double", (1, 1.0), "tabular"),
])
def test_heuristic_modality(spark, columns_, row, want):
    df = spark.createDataFrame([row], columns_)
    assert roles.heuristic_modality(df, "d").first()["heuristic"] == want


def test_constant_and_empty_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 2.0), (2.0, 5.0, None, 4.0), (3.0, 5.0, None, 6.0)], "a double, b double, c double, d double")
    got = profiling.strong_correlations(df).collect()
    assert [(r["first"], r["second"], round(r["r"], 9)) for r in got] == [("a", "d", 1.0)]
    assert columns.drop_all_null(df).columns == ["a", "b", "d"]


def test_profile_of_many_columns_takes_the_pairs_apart(spark, monkeypatch):
    df = spark.range(50).select(*[(F.col("id") % k).cast("double").alias(f"c{k}") for k in (2, 3, 4, 8)], F.lit(1).alias("target"))
    whole = profiling.dataset_profile(df, "target").first()
    monkeypatch.setattr(profiling, "PAIR_CHUNK", 2)
    assert profiling.dataset_profile(df, "target").first() == whole and "c4_c8=" in whole["correlations"]


def test_null_share_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, None), (2.0, "y"), (None, "z")], "a double, b string")
    assert {r["column"]: r["share"] for r in profiling.null_share(df).collect()} == {"a": 0.5, "b": 0.25}


def test_imbalance_and_types(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)], "y string")
    dist = profiling.class_distribution(df, "y")
    assert profiling.class_imbalance(dist).first()["imbalance"] == 6.0
    assert profiling.class_imbalance(profiling.class_distribution(df.limit(1), "y")).first()["imbalance"] == 1.0
    assert value(spark, profiling.loss_choice(F.lit("classification"), F.lit(6.0))) == "FocalLoss"
    assert value(spark, profiling.target_type(F.lit(20))) == "regression"
    assert value(spark, profiling.target_type(F.lit(0), "time_series")) == "sequence"


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, target int")
    row = profiling.dataset_profile(df, "target").first()
    assert row["num_samples"] == 0 and row["num_classes"] == 0 and row["imbalance"] == 1.0


def test_mean_and_sem(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 6.0), ("c", None)], "k string, x double")
    got = {r["k"]: (r["mean"], round(r["sem"], 6)) for r in statistics.mean_sem(df, ["k"], "x").collect()}
    assert got == {"a": (1.0, 0.0), "b": (3.0, round(math.sqrt(7 / 3), 6)), "c": (0.0, 0.0)}


def test_most_frequent_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    assert statistics.most_frequent(df, ["s"]).first()["value"] == "a"


# ---- features ---------------------------------------------------------------------------------------------
def test_fitted_statistics_ignore_the_test_table(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    test = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert [r["x"] for r in features.MedianImputer(["x"]).fit(train).transform(test).collect()] == [3.0, 100.0]
    scaled = features.RobustScaler(["x"]).fit(train).transform(train)
    assert [round(r["x"], 6) for r in scaled.collect()] == [round((v - 3) / 3.5, 6) for v in (1, 2, 4, 9)]
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["x"] for r in features.StandardScaler(["x"]).fit(const).transform(const).collect()] == [0.0, 0.0]


def test_unseen_category_is_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "s string")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "s string")
    got = {r["s"]: r["s_code"] for r in features.LabelEncoder("s").fit(train).transform(test).collect()}
    assert got == {"a": 0, "b": 1, "z": -1, None: -1}


def test_char_features(spark):
    df = spark.createDataFrame([(1, "aB1"), (2, "xyz"), (3, None)], "id long, s string")
    got = features.CharFeatures().fit(df).transform(df).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, -1, 3), (23, 24, 25, 3), (-1, -1, -1, 0)]


def test_poly_order(spark):
    row = features.poly2(spark.createDataFrame([(2.0, 3.0)], "a double, b double"), ["a", "b"]).first()
    assert [row[f"poly_{i}"] for i in range(5)] == [2.0, 3.0, 4.0, 6.0, 9.0]


def test_sequence_dictionary(spark):
    pairs = spark.createDataFrame([("1", "one"), ("1", "one"), ("1", "first"), ("2", "two"), ("2", "second")], "before string, after string")
    asked = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "before string")
    got = {r["before"]: r["after"] for r in features.SequenceNormalizer().fit(pairs).transform(asked).collect()}
    assert got == {"1": "one", "2": "second", "x": "x", "": ""}


def test_char_grams_of_short_words(spark):
    assert value(spark, text.char_grams(F.lit("a"))) == [" a", "a ", " a "]
    assert len(value(spark, text.char_grams(F.lit("abcdefgh")))) == 9 + 8 + 7 + 6 + 5


def test_word_tokens_need_whole_ascii_words(spark):
    assert value(spark, text.word_tokens(F.lit("Éa The cat_1 über on. x2 Ω"))) == ["the", "on"]


def test_word_tokens_at_every_character(spark):
    """Runs of letters, digits and underscores, kept if they are a to z: whatever the character beside, between or alone."""
    points = spark.range(0x11000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    texts = points.select(F.concat(F.lit("ab"), "c", F.lit("cd "), "c", F.lit(" x"), "c", F.lit(" "), "c", F.lit("y 1"), "c", F.lit("z"), "c", "c").alias("t"))
    runs = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    differ = texts.where(text.word_tokens(F.col("t")) != F.filter(runs, lambda w: w.rlike("^[a-z]+$")))
    assert differ.count() == 0 and texts.where(F.size(text.word_tokens(F.col("t"))) > 3).count() > 10_000


def test_a_bounded_fit_cuts_words_once(spark, monkeypatch):
    """Words are cut out of the texts once, also for the n-grams, and counted without a row for each."""
    cut, word_tokens, plans, written = [], text.word_tokens, [], text.written
    monkeypatch.setattr(text, "word_tokens", lambda t: cut.append(t) or word_tokens(t))
    monkeypatch.setattr(text, "written", lambda df, name="table": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    rows = [(1, "A b a b"), (1, "a B"), (2, "a, b Éc q7"), (None, "a b"), (None, "b"), (3, None), (4, "")]
    model = text.TfIdf("id", "text", "word", 50, 1, 1.0).fit(spark.createDataFrame(rows, "id long, text string"))
    assert len(cut) == 1 and not any("Generate explode" in p for p in plans)
    assert {r["term"]: r["df"] for r in model.vocabulary.collect()} == {"a": 3, "b": 3, "a b": 3, "b a": 1, "a b a": 1, "b a b": 1}


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c d")], "id long, text string")
    model = text.TfIdf("id", "text", "word").fit(docs)
    assert {r["term"]: r["df"] for r in model.vocabulary.collect()} == {"b": 2, "c": 2}
    got = {(r["id"], r["term"]): r["weight"] for r in model.transform(docs).collect()}
    assert got == pytest.approx({(1, "b"): 1.0, (2, "b"): 2**-0.5, (2, "c"): 2**-0.5, (3, "c"): 1.0})


@pytest.mark.parametrize("kind", ["word", "char"])
def test_bounded_tfidf_counts_inside_tasks(spark, kind):
    """A bounded vocabulary gives what an unbounded one gives, also with repeated and null keys; n-grams are not opened and shuffled."""
    rows = [(i % 40 if i % 7 else None, " ".join(f"w{'abcdefghij'[(i * j) % 10]} {'xyz'[j % 3]}é Q7 the" for j in range(i % 13))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (99, None), (98, "")], "id long, text string")
    whole, some = (text.TfIdf("id", "text", kind, limit, 2, 0.9).fit(docs) for limit in (None, 5000))
    vocabulary = lambda m: {(r["term"], r["df"], r["code"]) for r in m.vocabulary.collect()}
    weights = lambda df: {(r["id"], r["term"]): r["weight"] for r in df.collect()}
    assert vocabulary(some) == vocabulary(whole) and len(vocabulary(some)) > 10
    out = some.transform(docs)
    assert weights(out) == pytest.approx(weights(whole.transform(docs)), abs=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1
    best = whole.vocabulary.collect()
    few = text.TfIdf("id", "text", kind, 7, 2, 0.9).fit(docs).vocabulary.collect()
    assert len(few) == 7 and {r["term"] for r in few} <= {r["term"] for r in best}


def test_runs_of_a_key_that_goes_on_count_once(monkeypatch):
    """Sums leave a task in parts; a text that lies in several of them is one text."""
    monkeypatch.setattr(termcodes, "GRAMS", 3)
    monkeypatch.setattr(termcodes, "ROWS", 1)
    lists = pa.array([["a", "b", "a"], ["a", "b"], ["c", "a", "b"], ["a", "z", "b"], ["a", "b"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, None, None, 2]), lists], ["id", "t"])
    known = SimpleNamespace(value=["a", "b", "c"])
    total, df = Counter(), Counter()
    for part in termcodes.run_counts(known, 2, None, "id")([batch]):
        for r in part.to_pylist():
            total[r["run"]] += r["total"]
            df[r["run"]] += r["df"]
    assert total == {1: 4, 3: 1, 6: 1} and df == {1: 3, 3: 1, 6: 1}
    three = termcodes.run_counts(known, 3, SimpleNamespace(value=np.array([1, 3])), "id")([batch])
    assert [r for part in three for r in part.to_pylist()] == [{"run": 3, "total": 1, "df": 1}]


def test_words_of_a_key_that_goes_on_count_once(monkeypatch):
    monkeypatch.setattr(termcodes, "GRAMS", 3)
    monkeypatch.setattr(termcodes, "ROWS", 1)
    words = pa.array(["a b a", "a b", "", "b c", "c", "a b c c"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 1, None, 2]), words], ["id", "t"])
    total, df = Counter(), Counter()
    parts = list(termcodes.word_counts("id")([batch]))
    for r in (r for part in parts for r in part.to_pylist()):
        total[r["term"]] += r["total"]
        df[r["term"]] += r["df"]
    assert len(parts) > 2 and total == {"a": 4, "b": 4, "c": 4} and df == {"a": 2, "b": 2, "c": 3}


def test_many_words_are_numbered_as_few(monkeypatch):
    """A table of words beyond ``FEW`` is built once, not for every slice."""
    terms = ["a", "a b", "b", "b c a", "c"]
    lists, joined = pa.array([["a", "b", "c", "a"], [], ["z", "a", "b", "b"]], pa.list_(pa.string())), pa.array(["a b c a", "", "z a b b"])
    found = []
    for few in (0, 50_000):
        monkeypatch.setattr(termcodes, "FEW", few)
        found += [[(c.tolist(), n.tolist()) for c, n in termcodes.WordTerms(terms).counts(texts)] for texts in (lists, joined)]
    assert found == [[([0, 1, 2, 3, 4], [2, 1, 1, 1, 1]), ([], []), ([0, 1, 2], [1, 1, 2])]] * 4
    assert [(c.tolist(), n.tolist()) for c, n in termcodes.WordTerms([]).counts(joined)] == [([], [])] * 3


# ---- submissions ------------------------------------------------------------------------------------------
def plain_chars(words):
    padded = [f" {w} " for w in words if w]
    return Counter(w[i : i + k] for w in padded for k in range(2, 7) for i in range(len(w) - k + 1))


@pytest.mark.parametrize("states, characters", [(10**6, 250_000), (0, 250_000), (10**6, 7)])
def test_known_characters_are_found_by_states(monkeypatch, states, characters):
    """Beginnings of terms as states, in a table or searched, in one piece or in many, give what single look-ups give."""
    monkeypatch.setattr(termcodes, "STATES", states)
    monkeypatch.setattr(termcodes, "CHARACTERS", characters)
    texts = [["anna", "nan", "", "ann"], [], ["中文字", "𝒳anna", "q"], ["", "x" * 40], ["nanana"] * 3]
    terms = sorted([*plain_chars(["anna", "中文"]), "xxxxxx", "nanan", " q", "zz"])
    want = [sorted((terms.index(t), n) for t, n in plain_chars(words).items() if t in terms) for words in texts]
    lists, joined = pa.array(texts, pa.list_(pa.string())), pa.array([" ".join(t) for t in texts])
    look = termcodes.CharTerms(terms)
    assert not hasattr(look, "met")  # no word is opened for itself
    for given in (lists, joined):
        assert [list(zip(c.tolist(), n.tolist())) for c, n in look.counts(given)] == want
    assert [len(c) for c, _ in termcodes.CharTerms([]).counts(joined)] == [0] * 5


@pytest.mark.parametrize("letters", ["abé中𝒳", "".join(chr(0x4E00 + i) for i in range(1500))])
def test_totals_of_characters(monkeypatch, letters):
    """Keys of six characters outgrow an integer in large alphabets."""
    monkeypatch.setattr(termcodes, "WORDS", 50)
    words = ["".join(letters[(i * 7 + j * j * 31) % len(letters)] for j in range(i % 11 + 1)) for i in range(200)] + [letters]
    got, want = Counter(), Counter()
    for part in termcodes.gram_totals()([pa.RecordBatch.from_arrays([pa.array(words), pa.array([i % 3 + 1 for i in range(201)])], ["word", "c"])]):
        for r in part.to_pylist():
            got[r["term"]] += r["total"]
    for i, w in enumerate(words):
        for t, n in plain_chars([w]).items():
            want[t] += n * (i % 3 + 1)
    assert got == want


def test_rows_of_terms_leave_tasks_as_they_are(spark):
    """Lists of terms are not opened and their names not joined in Spark."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c d")], "id long, text string")
    out = text.TfIdf("id", "text", "char", 5, 1, 1.0).fit(docs).transform(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and out.count() > 5


def test_rounding_is_that_of_decimals(spark):
    values = [0.1234567885, 0.1234567895, 1.0000000005, 0.5, 1e-10, 4.9999999999e-10, 5e-10, 0.0, -0.1234567885, -3e-9, 1e20, float("nan"), None, *[i / 7919 + i * 1e-9 for i in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 9).alias("a"), numbers.rounded(F.col("x"), 9).alias("b"))
    assert [r for r in df.collect() if not (r.a == r.b or r.a != r.a and r.b != r.b)] == []


def test_bad_submission(spark, tmp_path):
    sub = spark.createDataFrame([(1, 0.5, 0.52, "x"), (1, None, 1.0, "y"), (2, 0.3, 0.7, "z")], "id long, a double, b double, note string")
    test = spark.range(4)
    r = submission.validate_submission(sub, "id", ["a", "b", "c"], test).first()
    assert not r["is_valid"]
    assert r["errors"] == ["Missing required columns: c", "Column 'a' has 1 missing values", "Row count mismatch: expected 4, got 3", "Found 1 duplicate IDs"]
    assert r["warnings"] == ["Extra columns present (will be ignored): note", "1 rows have probabilities not summing to 1"]
    with pytest.raises(ValueError):
        submission.save_submission(sub.drop("b", "note"), "id", ["a"], test, str(tmp_path), "s")
    good = submission.validate_submission(spark.range(4).withColumn("a", F.lit(0.1)), "id", ["a"], test).first()
    assert good["is_valid"] and good["errors"] == []


def test_medals_in_both_directions(spark):
    limits = lookups.threshold_table(spark, {"loss": (0.5, 0.4, 0.3, True), "rate": (0.85, 0.9, 0.94, False)})
    scores = spark.createDataFrame([("loss", 0.35), ("rate", 0.95), ("other", 1.0)], "competition string, score double")
    got = {r["competition"]: (r["medal"], r["has_threshold"]) for r in lookups.medal_band(scores, limits).collect()}
    assert got == {"loss": ("silver", True), "rate": ("gold", True), "other": ("none", False)}


def test_metric_lookup(spark):
    assert value(spark, lookups.lookup_default(F.lit("nothing"), {"rate": "auc"}, fixed.DEFAULT_METRIC)) == "accuracy"


# ---- logs -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("log, cls", [
    ("CUDA out of memory", "resource"), ("FileNotFoundError x", "data"), ("loss is NaN", "model"), ("info line", "model"),
    ("missing import", "data"), ("SyntaxError", "code"), ("all good", "unknown"),
])
def test_error_classes(spark, log, cls):
    assert value(spark, logtext.error_class(F.lit(log))) == cls


def test_log_text(spark):
    assert value(spark, logtext.stack_trace(F.lit("a\nb Traceback x\nc"))) == "b Traceback x\nc"
    assert value(spark, logtext.fenced_block(F.lit('x ```json\n{"a": 1}\n``` y'), "json")) == '{"a": 1}'
    assert value(spark, logtext.fenced_block(F.lit("no fence"), "json")) is None
    m = logtext.log_metrics(F.lit("Val score: 0.75\nAUC: 0.9\nTraining complete"))
    assert value(spark, m["val_score"]) == 0.75 and value(spark, m["train_score"]) is None and value(spark, m["completed"])
    g = logtext.grader_result(F.lit('{"score": 0.5, "medal": "Gold"} bronze'))
    assert tuple(value(spark, g)) == (0.5, "gold")
    assert tuple(value(spark, logtext.grader_result(F.lit("Silver with score 0.8")))) == (0.8, "silver")


def test_strings(spark):
    assert value(spark, strings.unique_chars(F.lit("aab"))) == 2 and value(spark, strings.unique_chars(F.lit(""))) == 0
    assert value(spark, strings.stem(F.lit("a.b/c.tar.gz"))) == "a.b/c.tar"
    assert value(spark, strings.normalize_path(F.lit("a\\b"))) == "a/b"


# ---- arrays and pictures ----------------------------------------------------------------------------------
def test_arrays(spark):
    a = F.array(*[F.lit(float(v)) for v in (0, 2, 4)])
    assert value(spark, arrays.pad(a, 5)) == [0, 2, 4, 0, 0] and value(spark, arrays.pad(a, 2)) == [0, 2]
    assert value(spark, arrays.resample(a, 7)) == pytest.approx(np.interp(np.linspace(0, 3, 7), [0, 1, 2], [0, 2, 4]).tolist())
    assert value(spark, arrays.minmax(a)) == pytest.approx([0, 0.5, 1])
    assert value(spark, arrays.real_mask(a, 4)) == [1, 1, 1, 0]
    assert sum(value(spark, numbers.softmax(a))) == pytest.approx(1.0)
    assert value(spark, numbers.argmax(a)) == 2


def test_spectrogram_finds_the_tone(spark):
    wave = np.sin(2 * np.pi * 8 * np.arange(64) / 32).tolist()  # 8 cycles in 32 samples: bin 8 of 16
    df = spark.createDataFrame([(1, wave)], "id long, wave array<double>")
    s = np.array(df.select(signals.spectrogram(F.col("wave"), 32, 16).alias("s")).first()["s"])
    assert s.shape == (17, 3) and (s.argmax(axis=0) == 8).all()
    pic = np.array(signals.log_spectrogram(df, "wave", 32, 16, 5).first()["spectrogram"])
    assert pic.shape == (17, 5) and pic.max() == pytest.approx(1.0) and (pic[:, 3:] == 0).all()


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_source_and_normalisation(spark, tmp_path):
    rgb = np.arange(48, dtype=np.uint8).reshape(4, 4, 3) * 5
    _png(tmp_path / "a.png", rgb)
    df = spark.read.format("image").load(str(tmp_path)).select("image.*").withColumn("id", F.lit(1))
    got = np.array(signals.normalize_images(df, "id", 2, (0.5, 0.5, 0.5), (0.25, 0.25, 0.25)).first()["pixels"]).reshape(2, 2, 3)
    assert got == pytest.approx((rgb[::2, ::2] / 255.0 - 0.5) / 0.25)


def test_integers_of_19_digits_keep_their_value(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    rows = ["id,over,mixed", "9007199254740993123,9223372036854775808,9007199254740993123", "9007199254740993124,1,1.5", "-9223372036854775808,2,2"]
    spark.createDataFrame([(r,) for r in rows], "v string").coalesce(1).write.text(path)
    got = readers.read_csv(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", "over": "string", "mixed": "double"}
    assert {r["id"] for r in got.collect()} == {9007199254740993123, 9007199254740993124, -9223372036854775808}


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_predictions_give_no_metric(spark, missing):
    df = spark.createDataFrame([(1, 0.9), (0, missing), (1, 0.8), (0, 0.1)], "y int, p double")
    y, p = F.col("y"), F.col("p")
    for name, (value, _) in metrics.BY_NAME.items():
        if value is not None:
            assert df.agg(value(p, y).alias("v")).first()["v"] is None, name
            assert df.where("p < 1 and not isnan(p)").agg(value(p, y).alias("v")).first()["v"] is not None, name
    assert metrics.auc(df, "y", ["p"]).first()["auc"] is None
    assert metrics.auc_by(df, F.col("y") * 0, "y", "p").first()["auc"] is None


def test_flawed_submissions_earn_no_medal(spark):
    answers = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, y int")
    limits = lookups.threshold_table(spark, {"c": (0.1, 0.2, 0.3, False)})
    whole = [(i, 0.1 + 0.8 * (i % 2)) for i in range(10)]
    cases = {
        None: whole, "missing ids": whole[:2], "unknown ids": [*whole, (77, 0.5)], "repeated ids": [*whole, (3, 0.9)],
        "missing predictions": [*whole[:9], (9, None)],
    }
    for reason, rows in cases.items():
        r = submission.grade_submission(spark.createDataFrame(rows, "id long, p double"), answers, "id", "c", limits).first()
        assert r["reason"] == reason and (r["score"], r["medal"]) == ((1.0, "gold") if reason is None else (None, "none"))


def test_inputs_without_any_file_are_reported(spark):
    listing = spark.createDataFrame([("a", "train/x.csv")], "dataset string, path string")
    expected = spark.createDataFrame([("a",), ("b",)], "dataset string")
    got = files.missing_inputs(listing, expected, ["train", "test"]).collect()
    assert sorted(map(tuple, got)) == [("a", "test"), ("b", "test"), ("b", "train")]


def test_blocks_keep_their_ids(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    b = spark.createDataFrame([(2, 0.5), (3, 0.7)], "id long, b double")
    assert sorted(map(tuple, lookups.hconcat_by_key([a, b], "id").collect())) == [(1, "x", None), (2, "y", 0.5), (3, None, 0.7)]
    table = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, v double")
    waves = spark.createDataFrame([(1, [0.5, 0.6], 1)], "id long, wave array<double>, label int")
    got = lookups.fuse_features(waves, table, "id", ["v"], 2).orderBy("id").collect()
    assert [r["features"] for r in got] == [[0.5, 0.6, 2.0], [0.0, 0.0, 3.0]]


def test_scratch_folders_go_with_their_scope(spark):
    import os

    from tablewright.session import scratch_scope, written

    outside = written(spark.range(3), "kept")
    with scratch_scope(spark):
        path = written(spark.range(5), "gone").inputFiles()[0]
    assert not os.path.exists(path.removeprefix("file://")) and outside.count() == 3
