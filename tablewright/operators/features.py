"""Fitted feature preparation as pyspark.ml estimators and models.

``fit`` runs one aggregate (or one dictionary build); ``transform`` is a projection or a lookup join. Fitted numbers
are plain values, at most a few per column, so training statistics never change with the table they are applied to. Models, and pipelines of
them, are saved and loaded like Spark's own.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.functions import strings
from tablewright.operators import ordered
from tablewright.operators import profiling as pf
from tablewright.operators import statistics as st
from tablewright.operators.roles import numeric_columns, string_columns
from tablewright.operators.saved import Fitted, Saved
from tablewright.session import written


class Step(Saved, Transformer):
    """A user-supplied feature function (DataFrame, **options) -> DataFrame as a stage. Functions of a module can be saved, with plain options."""

    def __init__(self, fn, **options):
        super().__init__()
        self.keep(options, functions={"fn": fn})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.functions["fn"](dataset, **self.stats)


class MedianImputer(Estimator):
    """Exact medians of the training rows; nulls and NaN are replaced."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        cols = self.cols or numeric_columns(df)
        row = ordered.quantile_row(df, cols, [0.5]).first()
        return MedianModel({c: row[f"{c}_q0"] for c in cols})


class MedianModel(Fitted):
    """``stats``: the median of each column."""

    def _transform(self, x):
        return x.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in self.stats.items()})


class ModeImputer(Estimator):
    """Most frequent training value per string column, the smallest on ties."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        cols = self.cols or string_columns(df)
        modes = {r["column"]: r["value"] for r in st.most_frequent(df, cols).collect()}  # one row per column
        return ModeModel({c: modes.get(c) for c in cols})


class ModeModel(Fitted):
    """``stats``: the mode of each column, None where all values were null."""

    def _transform(self, x):
        return x.withColumns({c: F.coalesce(F.col(c), F.lit(mode)) for c, mode in self.stats.items()})


class LabelEncoder(Estimator):
    """``<col>_code``: place among the sorted training values, -1 for unseen values and null."""

    def __init__(self, col, output=None):
        super().__init__()
        self.col, self.output = col, output or f"{col}_code"

    def _fit(self, df):
        codes = written(ordered.dense_codes(df, self.col)).select(
            F.col("value").alias(self.col), F.col("code").alias(self.output)
        )
        return LookupModel({"col": self.col, "output": self.output, "unseen": -1}, {"values": codes})


class LookupModel(Fitted):
    """The table ``values`` (col, output) as a lookup; ``unseen`` for null and what it does not hold."""

    def _transform(self, x):
        col, output, unseen = (self.stats[k] for k in ("col", "output", "unseen"))
        return x.join(self.tables["values"], col, "left").withColumn(output, F.coalesce(output, F.lit(unseen)))


class StandardScaler(Estimator):
    """(x - mean) / population sd; a constant column is divided by 1."""

    def __init__(self, cols):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in self.cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        stats = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in self.cols}
        return ScaleModel(stats)


class ScaleModel(Fitted):
    """``stats``: per column what is subtracted and what divides."""

    def _transform(self, x):
        return x.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})


class RobustScaler(Estimator):
    """(x - median) / (q75 - q25) from exact quantiles; a zero range is replaced by 1."""

    def __init__(self, cols):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        row = ordered.quantile_row(df, self.cols, [0.25, 0.5, 0.75]).first()
        stats = {c: (row[f"{c}_q1"], (row[f"{c}_q2"] - row[f"{c}_q0"]) or 1.0) for c in self.cols}
        return ScaleModel(stats)


class Interactions(Estimator):
    """Sums of correlated column pairs and their three-way threshold against the training quantiles.

    All pairs with a strong correlation; ``pairs`` keeps the first so many in column order.
    """

    def __init__(self, cols, pairs: int | None = None):
        super().__init__()
        self.cols, self.limit = cols, pairs

    def _fit(self, df):
        pairs = []
        if len(self.cols) > 2:
            found = pf.correlations(df, self.cols).where(F.abs("r") > fixed.INTERACTION_CORRELATION)
            pairs = [(r["first"], r["second"]) for r in found.orderBy("position").collect()][: self.limit]
        names = {p: f"i_{p[0]}_{p[1]}" for p in pairs}
        limits = {}
        if pairs:
            sums = df.select([(F.col(a) + F.col(b)).alias(f"{n}_sum") for (a, b), n in names.items()])
            limits = ordered.quantile_row(sums, sums.columns, [fixed.LOWER_QUANTILE, fixed.UPPER_QUANTILE]).first().asDict()
        return InteractionModel({"pairs": [[a, b, n] for (a, b), n in names.items()], "limits": limits})


class InteractionModel(Fitted):
    """``stats``: the pairs with their names, and the quantiles of their sums."""

    def _transform(self, x):
        limits = self.stats["limits"]
        for a, b, n in self.stats["pairs"]:
            total = F.col(a) + F.col(b)
            above = F.coalesce((total > limits[f"{n}_sum_q1"]).cast("int"), F.lit(0))
            below = F.coalesce((total < limits[f"{n}_sum_q0"]).cast("int"), F.lit(0))
            x = x.withColumns({f"{n}_sum": total, f"{n}_thresh": above - below})
        return x


def char_columns(col: str, length: int, upper: bool = True) -> dict:
    """Codes of the first ``length`` positions and the number of distinct characters of one string column."""
    out = {f"{col}_char_{i}": strings.char_position(F.col(col), i, upper) for i in range(length)}
    out = {k: F.coalesce(v, F.lit(-1)) for k, v in out.items()}
    out[f"{col}_unique_chars"] = strings.unique_chars(F.col(col))
    return out


class CharFeatures(Estimator):
    """Character features for string columns of nearly fixed length; the source column is dropped.

    Lengths are judged over the whole column. All positions up to the most common length; ``positions`` keeps the first so many.
    """

    def __init__(self, skip=("id", "target"), positions: int | None = None):
        super().__init__()
        self.skip, self.positions = skip, positions

    def _fit(self, df):
        cols = [c for c in string_columns(df) if c not in self.skip]
        lengths = {}
        if cols:
            for r in st.string_length_stats(df, cols).collect():  # one row per column
                if r["sd"] is not None and r["sd"] < fixed.FIXED_LENGTH_SD and r["mean"] >= fixed.FIXED_LENGTH_MEAN:
                    lengths[r["column"]] = r["mode"]
        return CharModel({c: min(lengths[c], self.positions or lengths[c]) for c in cols if c in lengths})


class CharModel(Fitted):
    """``stats``: per column the number of its positions."""

    def _transform(self, x):
        for c, positions in self.stats.items():
            x = x.withColumns(char_columns(c, positions)).drop(c)
        return x


class TargetEncoder(Estimator):
    """Mean training target per category; the global mean for unseen and null categories."""

    def __init__(self, col, target):
        super().__init__()
        self.col, self.target = col, target

    def _fit(self, df):
        out = f"{self.col}_mean"
        overall = df.agg(F.avg(self.target)).first()[0]
        means = written(df.where(F.col(self.col).isNotNull()).groupBy(self.col).agg(F.avg(self.target).alias(out)))
        return LookupModel({"col": self.col, "output": out, "unseen": overall}, {"values": means})


def poly2(df: DataFrame, cols) -> DataFrame:
    """The columns, then all products of two of them (squares included) as poly_0 ... in that order, appended."""
    terms = [F.col(c).cast("double") for c in cols]
    terms += [F.col(a).cast("double") * F.col(b).cast("double") for a, b in combinations_with_replacement(cols, 2)]
    return df.withColumns({f"poly_{i}": t for i, t in enumerate(terms)})


class SequenceNormalizer(Estimator):
    """Most frequent ``after`` of every ``before`` (smallest on ties); unseen input stays as it is."""

    def _fit(self, df):
        pairs = df.select(strings.fill_text(F.col("before")).alias("before"), strings.fill_text(F.col("after")).alias("after"))
        counts = pairs.groupBy("before", "after").agg(F.count("*").alias("n"))
        best = counts.groupBy("before").agg(F.min_by("after", F.struct(-F.col("n"), F.col("after"))).alias("best"))
        return NormalizerModel(tables={"best": best})


class NormalizerModel(Fitted):
    """The table ``best`` (before, best)."""

    def _transform(self, x):
        x = x.withColumn("before", strings.fill_text(F.col("before")))
        return x.join(self.tables["best"], "before", "left").withColumn("after", F.coalesce("best", "before")).drop("best")


def seq_prepare(df: DataFrame, col: str, length: int) -> DataFrame:
    """Task prefix in front of the text; the first ``length`` tokens are the model input."""
    tokens = F.split(F.concat(F.lit(fixed.TASK_PREFIX), strings.fill_text(F.col(col))), " ")
    return df.withColumn("tokens", F.slice(tokens, 1, length))
