"""Queries: fitted feature preparation."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablewright.functions import strings
from tablewright.operators import features as ft
from tablewright.plans.registry import query
from tablewright.plans.statistics import rounded
from tablewright.session import checkpointed, scratch


def char_sql(col, upper=True, n=10):
    src = f"upper({col})" if upper else col
    out = []
    for i in range(1, n + 1):
        ch = f"substr({src}, {i}, 1)"
        out.append(f"CASE WHEN regexp_matches({ch}, '^\\p{{L}}$') THEN unicode({ch}) - 65 ELSE -1 END AS {col}_char_{i - 1}")
    out.append(f"CAST(coalesce(len(list_distinct(string_split({col}, ''))), 0) AS INTEGER) AS {col}_unique_chars")
    return ", ".join(out)


@query("char_positions", f"SELECT id, {char_sql('code', upper=False, n=18)} FROM names", ("names",))
def char_positions(t):
    return t.names.select("id", *[v.alias(k) for k, v in ft.char_columns("code", 18, upper=False).items()])


@query("char_features_auto", f"SELECT id, bal, nation, {char_sql('code', n=18)}, {char_sql('seg', n=9)}, {char_sql('seg_null', n=9)} FROM names", ("names",))
def char_features_auto(t):
    return ft.CharFeatures().fit(t.names).transform(t.names)


@query("unique_chars", """SELECT doc_id AS id, CAST(len(list_distinct(string_split(text, ''))) AS INTEGER) AS n FROM documents""")
def unique_chars(t):
    return t.documents.select(F.col("doc_id").alias("id"), strings.unique_chars(F.col("text")).alias("n"))


INTERACT = ["chars", "words", "lines", "word_length"]
PAIRS = [("chars", "words"), ("chars", "lines"), ("words", "lines")]


def fitted_interactions(t):
    measures = checkpointed(t.docstats.select("id", *INTERACT, "is_train"))  # the fit scans them several times
    return ft.Interactions(INTERACT).fit(measures.where("is_train")).transform(measures)


@query("interaction_sum", "SELECT id, " + ", ".join(f"{a} + {b} AS i_{a}_{b}_sum" for a, b in PAIRS) + " FROM docstats", ("docstats",))
def interaction_sum(t):
    out = fitted_interactions(t)
    return out.select("id", *[c for c in out.columns if c.endswith("_sum")])


@query("interaction_thresh", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({a} + {b}, 0.85) AS u_{a}_{b}, quantile_cont({a} + {b}, 0.15) AS l_{a}_{b}" for a, b in PAIRS
) + " FROM docstats WHERE is_train) SELECT id, " + ", ".join(
    f"CAST({a} + {b} > u_{a}_{b} AS INTEGER) - CAST({a} + {b} < l_{a}_{b} AS INTEGER) AS i_{a}_{b}_thresh" for a, b in PAIRS
) + " FROM docstats, q", ("docstats",))
def interaction_thresh(t):
    out = fitted_interactions(t)
    return out.select("id", *[c for c in out.columns if c.endswith("_thresh")])


@query("impute_median", """SELECT order_id, quantity, round(coalesce(price, (SELECT median(price) FROM items WHERE is_train)), 6) AS price FROM items""", ("items",))
def impute_median(t):
    model = ft.MedianImputer(["quantity", "price"]).fit(t.items.where("is_train"))
    return model.transform(t.items).select("order_id", "quantity", F.round("price", 6).alias("price"))


@query("impute_mode", """SELECT id, coalesce(priority, (SELECT priority FROM tab WHERE is_train AND priority IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM tab""", ("tab",))
def impute_mode(t):
    return ft.ModeImputer(["priority"]).fit(t.tab.where("is_train")).transform(t.tab).select("id", "priority")


@query("fill_text", "SELECT id, coalesce(priority, '') AS priority, coalesce(CAST(target AS VARCHAR), '') AS target FROM tab", ("tab",))
def fill_text(t):
    return t.tab.select("id", strings.fill_text(F.col("priority")).alias("priority"), strings.fill_text(F.col("target")).alias("target"))


@query("label_encode", """SELECT id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS lang_code FROM docstats""", ("docstats",))
def label_encode(t):
    return ft.LabelEncoder("lang").fit(t.docstats).transform(t.docstats.select("id", "lang"))


@query("poly2", """SELECT id, a AS poly_0, b AS poly_1, c AS poly_2, a * a AS poly_3, a * b AS poly_4, a * c AS poly_5,
    b * b AS poly_6, b * c AS poly_7, c * c AS poly_8 FROM multi""", ("multi",))
def poly2(t):
    return ft.poly2(t.multi, ["a", "b", "c"]).drop("a", "b", "c", "y")


@query("user_step", "SELECT id, price / (1 + cust) AS ratio FROM tab", ("tab",))
def user_step(t):
    """A user's feature function as a pipeline stage."""
    step = ft.Step(lambda df: df.withColumn("ratio", F.col("price") / (1 + F.col("cust"))))
    return Pipeline(stages=[step]).fit(t.tab).transform(t.tab).select("id", "ratio")


@query("scale_standard", """SELECT order_id, round((quantity - (SELECT avg(quantity) FROM items WHERE is_train)) / (SELECT stddev_pop(quantity) FROM items WHERE is_train), 6) AS quantity,
    round((tax - (SELECT avg(tax) FROM items WHERE is_train)) / (SELECT stddev_pop(tax) FROM items WHERE is_train), 6) AS tax FROM items""", ("items",))
def scale_standard(t):
    out = ft.StandardScaler(["quantity", "tax"]).fit(t.items.where("is_train")).transform(t.items)
    return rounded(out.select("order_id", "quantity", "tax"), "quantity", "tax", digits=6)


@query("scale_robust", """WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS b,
      quantile_cont(quantity, 0.25) AS c, quantile_cont(quantity, 0.5) AS k, quantile_cont(quantity, 0.75) AS d FROM items WHERE is_train)
    SELECT order_id, round((price - m) / (b - a), 6) AS price, round((quantity - k) / (d - c), 6) AS quantity FROM items, q""", ("items",))
def scale_robust(t):
    out = ft.RobustScaler(["price", "quantity"]).fit(t.items.where("is_train")).transform(t.items)
    return rounded(out.select("order_id", "price", "quantity"), "price", "quantity", digits=6)


@query("target_encode", """SELECT id, source, round(coalesce(m, (SELECT avg(words) FROM docstats WHERE is_train AND lang <> 'en')), 6) AS source_mean
    FROM docstats LEFT JOIN (SELECT source AS s, avg(words) AS m FROM docstats WHERE is_train AND lang <> 'en' GROUP BY 1) ON s = source""", ("docstats",))
def target_encode(t):
    train = t.docstats.where("is_train and lang <> 'en'")
    out = ft.TargetEncoder("source", "words").fit(train).transform(t.docstats)
    return rounded(out.select("id", "source", "source_mean"), "source_mean", digits=6)


@query("text_clean", r"""SELECT doc_id AS id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def text_clean(t):
    return t.documents.select(F.col("doc_id").alias("id"), strings.clean_text(F.col("text")).alias("text"))


@query("seq_normalize", """WITH p AS (SELECT coalesce(before, '') AS before, coalesce(after, '') AS after FROM s2s),
    b AS (SELECT before, arg_min(after, (-n, after)) AS best FROM (SELECT before, after, -count(*) AS m, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT c.conv_id, c.turn, coalesce(b.best, c.text) AS after FROM conversations c LEFT JOIN b ON b.before = c.text""", ("s2s",))
def seq_normalize(t):
    asked = t.conversations.select("conv_id", "turn", F.col("text").alias("before"))
    return ft.SequenceNormalizer().fit(t.s2s).transform(asked).select("conv_id", "turn", "after")


@query("seq_prepare", """SELECT id, array_to_string(string_split(concat('transform: ', before), ' ')[1:128], ' ') AS tokens,
    CAST(len(string_split(concat('transform: ', before), ' ')[1:128]) AS INTEGER) AS n FROM s2s""", ("s2s",))
def seq_prepare(t):
    out = ft.seq_prepare(t.s2s, "before", 128)
    return out.select("id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


def with_ratio(df, of, to):
    return df.withColumn("ratio", F.col(of) / (1 + F.col(to)))


@query("saved_pipeline", """WITH f AS (SELECT *, coalesce(priority, (SELECT priority FROM tab WHERE is_train AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS filled,
      coalesce(price, (SELECT median(price) FROM tab WHERE is_train)) AS cost FROM tab),
    c AS (SELECT filled AS k, dense_rank() OVER (ORDER BY filled) - 1 AS code FROM (SELECT DISTINCT filled FROM f WHERE is_train)),
    q AS (SELECT quantile_cont(cost, 0.25) AS a, median(cost) AS m, quantile_cont(cost, 0.75) AS b FROM f WHERE is_train)
    SELECT id, filled AS priority, CAST(coalesce(code, -1) AS BIGINT) AS priority_code, round((cost - m) / coalesce(nullif(b - a, 0), 1), 6) AS price,
      round((cost - m) / coalesce(nullif(b - a, 0), 1) / (1 + cust), 6) AS ratio FROM f CROSS JOIN q LEFT JOIN c ON k = filled""", ("tab",))
def saved_pipeline(t):
    """A pipeline of fitted preparation, saved and loaded again before it is used."""
    steps = [ft.ModeImputer(["priority"]), ft.LabelEncoder("priority"), ft.MedianImputer(["price"]), ft.RobustScaler(["price"]), ft.Step(with_ratio, of="price", to="cust")]
    path = scratch(t.spark, "pipeline")
    Pipeline(stages=steps).fit(t.tab.where("is_train")).write().save(path)
    out = PipelineModel.load(path).transform(t.tab).select("id", "priority", F.col("priority_code").cast("long").alias("priority_code"), "price", "ratio")
    return rounded(out, "price", "ratio", digits=6)
