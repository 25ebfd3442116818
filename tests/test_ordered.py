"""Order primitives, sampling, run histories on small tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import metrics, ordered, runs, sampling


def test_quantiles_of_the_quartet(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "x double")
    got = {r["q"]: r["quantile"] for r in ordered.exact_quantiles(df, ["x"], [0.0, 0.5, 0.85, 1.0]).collect()}
    assert got == pytest.approx({0.0: 1.0, 0.5: 3.0, 0.85: 6.75, 1.0: 9.0})


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "x double, e double")
    row = ordered.quantile_row(df, ["x", "e"], [0.5]).first()
    assert row["x_q0"] == 2.0 and row["e_q0"] is None


def test_quantiles_equal_pandas_on_heavy_ties(spark):
    rng = random.Random(3)
    values = [7.0] * 400 + [round(rng.gauss(0, 5), 2) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = [0.1, 0.15, 0.5, 0.85, 0.99]
    got = {r["q"]: r["quantile"] for r in ordered.exact_quantiles(df, ["x"], probs).collect()}
    want = pd.Series(values).quantile(probs)
    assert got == pytest.approx({p: want[p] for p in probs})


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0)], "id long, s double")
    assert {r["id"]: r["rank"] for r in ordered.average_ranks(df, "id", ["s"]).collect()} == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}


def test_average_ranks_equal_pandas(spark):
    rng = random.Random(5)
    pdf = pd.DataFrame({"id": range(500), "a": [rng.randint(0, 40) / 8 for _ in range(500)], "b": [rng.random() for _ in range(500)]})
    got = ordered.average_ranks(spark.createDataFrame(pdf), "id", ["a", "b"]).toPandas().pivot(index="id", columns="name", values="rank")
    pd.testing.assert_frame_equal(got[["a", "b"]], pdf[["a", "b"]].rank(), check_names=False, check_index_type=False)


def test_dense_codes_over_many_values(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), (F.col("id") % 2500).cast("string")).alias("v"))
    got = {r["value"]: r["code"] for r in ordered.dense_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({f"v{i}" for i in range(2500)}))}


def test_running_over_blocks_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.random()) for i in range(300)] + [(k, i, rng.random()) for k in (1, 2) for i in range(0, 60, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = ordered.running(
        df, ["k"], "i", {"hi": ("max", F.col("v")), "n": ("sum", F.lit(1)), "before": ("min", F.col("v"))}, exclusive=("before",)
    ).toPandas().sort_values(["k", "i"])
    g = got.groupby("k")["v"]
    assert (got["hi"] == g.cummax()).all()
    assert (got["n"] == g.cumcount() + 1).all()
    shifted = g.transform(lambda s: s.cummin().shift())
    assert got["before"].fillna(-1).eq(shifted.fillna(-1)).all()


def test_samples_are_exact_and_nested_by_order(spark):
    df = spark.range(1003)
    small = {r[0] for r in sampling.sample_fraction(df, "id", 0.1, 42).collect()}
    large = {r[0] for r in sampling.sample_fraction(df, "id", 0.3, 42).collect()}
    assert len(small) == 100 and len(large) == 301 and small < large
    assert sampling.sample_cap(df, "id", 50, 42).count() == 50
    assert sampling.sample_cap(df, "id", 5000, 42).count() == 1003
    assert sampling.sample_fraction(df, "id", 0.0, 42).count() == 0
    assert sampling.sample_fraction(df.limit(0), "id", 0.5, 42).count() == 0


def test_stratified_split_and_folds(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "a").when(F.col("id") < 995, "b").otherwise("c").alias("y"))
    s = sampling.split_stratified(df, "id", "y", 0.1, 7).groupBy("y").agg(F.count_if("is_validation").alias("n"))
    assert {r["y"]: r["n"] for r in s.collect()} == {"a": 70, "b": 30, "c": 0}  # half goes to the even number
    folds = sampling.kfold_stratified(df, "id", "y", 5, 7).groupBy("y", "fold").count().toPandas()
    spread = folds.groupby("y")["count"].agg(["min", "max", "sum", "size"])
    assert (spread["max"] - spread["min"] <= 1).all() and (spread["size"] == 5).all() and spread["sum"].sum() == 1000


def test_early_stop(spark):
    loss = [5, 4, 4, 3, 3, 3.5, 3, 2]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(loss)] + [(2, i, float(-i)) for i in range(4)], "run long, step long, loss double")
    got = {r["run"]: r for r in runs.early_stop(df, "run", "step", "loss", 3).collect()}
    assert (got[1]["stopped"], got[1]["stop_step"], got[1]["best_step"], got[1]["best_loss"]) == (True, 6, 3, 3.0)
    assert (got[2]["stopped"], got[2]["stop_step"], got[2]["best_step"]) == (False, 3, 3)


def test_auc_ties_and_symmetry(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1), (0, 0.5)], "y int, s double").withColumn("r", 1 - F.col("s"))
    got = {r["name"]: r["auc"] for r in metrics.auc(df, "y", ["s", "r"]).collect()}
    assert got["s"] == pytest.approx(5 / 6) and got["s"] + got["r"] == pytest.approx(1.0)
    one = metrics.auc(df.where("y = 1"), "y", ["s"]).first()["auc"]
    assert one is None


def test_running_over_sparse_keys_near_the_end_of_the_range(spark):
    import random

    rng = random.Random(8)
    ids = rng.sample(range(2**60, 2**60 + 10**15), 500) + [2**60 - k for k in range(1, 200)]
    rows = [(0, i, rng.random()) for i in ids]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    got = ordered.running(df, ["k"], "i", {"hi": ("max", F.col("v")), "n": ("sum", F.lit(1))}).orderBy("i").collect()
    best = 0.0
    for n, (_, i, v) in enumerate(sorted(rows, key=lambda r: r[1]), 1):
        best = max(best, v)
        assert (got[n - 1]["i"], got[n - 1]["hi"], got[n - 1]["n"]) == (i, best, n)
    assert ordered.in_blocks(df, "i").select("_block").distinct().count() > 2
