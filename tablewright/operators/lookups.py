"""Joins: semi, anti, full outer, lookups with defaults, encodings, pivots."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.arrays import or_silence
from tablewright.operators.ordered import dense_codes
from tablewright.session import written


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def literal_map(values: dict) -> Column:
    """A small fixed mapping as a map column."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def lookup_default(key: Column, values: dict, default) -> Column:
    """The mapped value, or the default (a literal or a column) for unknown keys."""
    out = F.try_element_at(literal_map(values), key)
    return F.coalesce(out, default if isinstance(default, Column) else F.lit(default))


def run_grid(runs: DataFrame, competitions: DataFrame, seeds) -> DataFrame:
    """(competition, seed, found, score): every expected pair with its first run by step.

    The grid is the competition list times a literal seed array; the first run is a minimum, not a sort.
    """
    grid = competitions.select("competition", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"))
    first = runs.groupBy("competition", "seed").agg(F.min_by("score", "step").alias("score"))
    return grid.join(first, ["competition", "seed"], "left").select(
        "competition", "seed", F.col("score").isNotNull().alias("found"), "score"
    )


def grade_join(submission: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Full outer join; ``status`` is matched, missing (no row submitted) or extra (unknown id).

    A submission must not carry an id twice: the scores of repeated ids are averaged and counted in ``copies``.
    """
    sub = submission.groupBy(key).agg(F.avg("p").alias("p"), F.count("*").alias("copies"))
    return sub.withColumn("s", F.lit(True)).join(answers.withColumn("a", F.lit(True)), key, "full").select(
        key, "y", "p", F.coalesce("copies", F.lit(0)).alias("copies"),
        F.when(F.col("s") & F.col("a"), "matched").when(F.col("a"), "missing").otherwise("extra").alias("status"),
    )


def medal(score: Column, bronze: Column, silver: Column, gold: Column, lower_is_better: Column) -> Column:
    """Best medal whose threshold is met; null thresholds give 'none'."""

    def met(limit):
        return F.coalesce(F.when(lower_is_better, score <= limit).otherwise(score >= limit), F.lit(False))

    return F.when(met(gold), "gold").when(met(silver), "silver").when(met(bronze), "bronze").otherwise("none")


def medal_band(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores with medal, margin to bronze (positive = better) and ``has_threshold``."""
    c = F.col
    j = scores.join(thresholds, "competition", "left")
    margin = F.when(c("lower_is_better"), c("bronze") - c("score")).otherwise(c("score") - c("bronze"))
    return j.select(
        *scores.columns, c("bronze").isNotNull().alias("has_threshold"),
        medal(c("score"), c("bronze"), c("silver"), c("gold"), c("lower_is_better")).alias("medal"), margin.alias("margin"),
    )


def threshold_table(spark, values: dict) -> DataFrame:
    """(competition, bronze, silver, gold, lower_is_better) from a fixed mapping."""
    rows = [(k, *map(float, v[:3]), bool(v[3])) for k, v in values.items()]
    return spark.createDataFrame(rows, "competition string, bronze double, silver double, gold double, lower_is_better boolean")


def hconcat_by_key(blocks, key: str) -> DataFrame:
    """Feature blocks side by side; a key that a block lacks has nulls there."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key, "full")
    return out


def stack_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """Sparse (id, term, weight) blocks under each other, terms prefixed by the block name."""
    out = None
    for name, df in blocks.items():
        part = df.select("id", F.concat(F.lit(f"{name}:"), "term").alias("term"), "weight")
        out = part if out is None else out.unionByName(part)
    return out


def stack_predictions(preds: DataFrame, models) -> DataFrame:
    """One column per model from the long table (id, model, score)."""
    return preds.groupBy("id").pivot("model", list(models)).agg(F.first("score"))


def fuse_features(signals: DataFrame, table: DataFrame, key: str, numbers, length: int) -> DataFrame:
    """(key, features, label) for every row of ``table``: its signal, ``length`` zeros if it has none, then its numeric columns."""
    extra = F.array(*[F.col(c).cast("double") for c in numbers])
    wave = or_silence(F.col("wave"), length)
    return table.join(signals, key, "left").select(key, F.concat(wave, extra).alias("features"), "label")


def encode_unseen(train: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """``<col>_code``: position of the value among the sorted training values, -1 when it is new or null."""
    codes = written(dense_codes(train, col)).select(F.col("value").alias(col), F.col("code").alias(f"{col}_code"))
    return df.join(codes, col, "left").withColumn(f"{col}_code", F.coalesce(f"{col}_code", F.lit(-1)))
