"""Queries: table profile."""

from pyspark.sql import functions as F

from tablewright.operators import profiling as pf
from tablewright.plans.registry import query
from tablewright.plans.roles import stacked

TAB_TYPES = [("id", "bigint"), ("price", "double"), ("cust", "double"), ("priority", "string"), ("status", "string"),
             ("target", "int"), ("is_train", "boolean")]


@query("profile_types", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS type, count({c}) AS non_null FROM tab""" for c, k in TAB_TYPES), ("tab",))
def profile_types(t):
    return pf.profile_types(t.tab)


@query("null_share", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg(CAST({c} IS NULL AS DOUBLE)) AS share FROM tab HAVING share > 0""" for c, _ in TAB_TYPES), ("tab",))
def null_share(t):
    return pf.null_share(t.tab)


@query("class_distribution", """SELECT priority AS value, count(*) AS n FROM tab WHERE priority IS NOT NULL GROUP BY 1
    UNION ALL SELECT CAST(target AS VARCHAR), count(*) FROM labelled GROUP BY 1""", ("tab", "labelled"))
def class_distribution(t):
    return stacked([pf.class_distribution(t.tab, "priority"), pf.class_distribution(t.labelled, "target"),
                    pf.class_distribution(t.tab, "price")])


DOC_NUMBERS = ["chars", "words", "lines", "word_length"]
DOC_PAIRS = [(a, b) for i, a in enumerate(DOC_NUMBERS) for b in DOC_NUMBERS[i + 1:]]


@query("strong_correlations", "SELECT first, second, round(r, 9) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS r FROM docstats" for a, b in DOC_PAIRS
) + ") WHERE NOT isnan(r) AND abs(r) > 0.5", ("docstats",))
def strong_correlations(t):
    return pf.strong_correlations(t.docstats, DOC_NUMBERS).withColumn("r", F.round("r", 9))


@query("profile_counts", "SELECT count(*) AS num_samples, 7 AS num_features FROM items", ("items",))
def profile_counts(t):
    return pf.profile_counts(t.items)


TAB_BYTES = "CAST(sum(29 + coalesce(strlen(priority), 0) + coalesce(strlen(status), 0)) AS BIGINT)"


@query("profile_bytes", f"SELECT {TAB_BYTES} AS bytes FROM tab", ("tab",))
def profile_bytes(t):
    return pf.profile_bytes(t.tab)


@query("dataset_profile", """WITH items2 AS (SELECT order_id, quantity, price, discount, tax, is_train, flag AS target FROM items),
    d AS (SELECT target, count(*) AS n FROM items2 GROUP BY 1)
    SELECT count(*) AS num_samples, 7 AS num_features, CAST(sum(41 + strlen(target)) AS BIGINT) AS bytes,
      'order_id=bigint;quantity=double;price=double;discount=double;tax=double;is_train=boolean;target=string' AS data_types,
      format('price={:.6f}', avg(CAST(price IS NULL AS DOUBLE))) AS missing,
      CASE WHEN corr(quantity, price) > 0.5 THEN format('quantity_price={:.6f}', corr(quantity, price)) ELSE '' END AS correlations,
      (SELECT count(*) FROM d) AS num_classes, (SELECT round(max(n) / min(n), 6) FROM d) AS imbalance,
      'classification' AS target_type, 'CrossEntropy' AS loss FROM items2""", ("items",))
def dataset_profile(t):
    return pf.dataset_profile(t.items.select("order_id", "quantity", "price", "discount", "tax", "is_train", F.col("flag").alias("target")), "target")


TARGETS = [("tab", "target"), ("tab", "price"), ("names", "nation"), ("names", "seg_null"), ("labelled", "target")]


def per_target(t, fn):
    out = []
    for v, c in TARGETS:
        out.append(fn(getattr(t, v), c).select(F.lit(v).alias("dataset"), F.lit(c).alias("target_column"), "*"))
    return stacked(out)


def counts_sql(discrete_only=True):
    rows = []
    for v, c in TARGETS:
        n = "0 * count(*)" if c == "price" and discrete_only else f"count(DISTINCT {c})"
        rows.append(f"SELECT '{v}' AS dataset, '{c}' AS target_column, {n} AS num_classes FROM {v}")
    return " UNION ALL ".join(rows)


TYPE_SQL = "CASE WHEN num_classes = 0 THEN 'classification' WHEN num_classes < 20 THEN 'classification' ELSE 'regression' END"


@query("target_type", f"SELECT *, {TYPE_SQL} AS target_type FROM ({counts_sql()})", ("tab", "names", "labelled"))
def target_type(t):
    kind = pf.target_type(F.col("num_classes")).alias("target_type")
    return per_target(t, lambda df, c: pf.class_imbalance(pf.class_distribution(df, c)).select("num_classes", kind))


@query("task_metric", f"""SELECT dataset, target_column, num_classes,
      CASE WHEN target_column <> 'price' AND num_classes < 20 THEN 'classification' ELSE 'regression' END AS task,
      CASE WHEN target_column <> 'price' AND num_classes = 2 THEN 'roc_auc'
        WHEN target_column <> 'price' AND num_classes < 20 THEN 'log_loss' ELSE 'r2' END AS metric
    FROM ({counts_sql(False)})""", ("tab", "names", "labelled"))
def task_metric(t):
    return per_target(t, pf.task_metric)


IMBALANCE_SQL = " UNION ALL ".join(
    f"""SELECT '{v}' AS dataset, '{c}' AS target_column, count(*) AS num_classes,
      CASE WHEN count(*) < 2 THEN 1.0::double ELSE max(n) / min(n) END AS imbalance
      FROM (SELECT {c}, count(*) AS n FROM {v} WHERE {c} IS NOT NULL AND {'false' if c == 'price' else 'true'} GROUP BY 1)"""
    for v, c in TARGETS)


@query("class_imbalance", IMBALANCE_SQL, ("tab", "names", "labelled"))
def class_imbalance(t):
    return per_target(t, lambda df, c: pf.class_imbalance(pf.class_distribution(df, c)))


@query("loss_choice", f"""SELECT dataset, target_column, CASE WHEN {TYPE_SQL} = 'regression' THEN 'MSE'
    WHEN imbalance > 5 THEN 'FocalLoss' ELSE 'CrossEntropy' END AS loss FROM ({IMBALANCE_SQL})""", ("tab", "names", "labelled"))
def loss_choice(t):
    kind = pf.target_type(F.col("num_classes"))
    loss = pf.loss_choice(kind, F.col("imbalance")).alias("loss")
    return per_target(t, lambda df, c: pf.class_imbalance(pf.class_distribution(df, c)).select(loss))
