"""Raw tables and the derived views the registered queries run on.

Every view is a projection, join or union over whole tables; ``VIEW_SQL`` is the same view in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def d(x: float):
    return F.lit(float(x))


class Tables:
    """Lazy access to raw tables and views by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return VIEWS[name](self)
        raise AttributeError(name)


def _tab(t):
    c = F.col
    return t.orders.select(
        c("o_orderkey").alias("id"),
        F.when((c("o_orderstatus") == "P") & (c("o_orderpriority") == "5-LOW"), None).otherwise(c("o_totalprice")).alias("price"),
        c("o_custkey").cast("double").alias("cust"),
        F.when(c("o_orderpriority") == "4-NOT SPECIFIED", None).otherwise(c("o_orderpriority")).alias("priority"),
        c("o_orderstatus").alias("status"),
        (c("o_orderstatus") == "F").cast("int").alias("target"),
        (c("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("is_train"),
    )


def _names(t):
    c = F.col
    return t.customer.select(
        c("c_custkey").alias("id"),
        c("c_name").alias("code"),
        c("c_mktsegment").alias("seg"),
        F.when(c("c_acctbal") < 0, None).otherwise(c("c_mktsegment")).alias("seg_null"),
        c("c_acctbal").alias("bal"),
        c("c_nationkey").alias("nation"),
    )


def _items(t):
    c = F.col
    return t.lineitem.select(
        c("l_orderkey").alias("order_id"),
        c("l_quantity").alias("quantity"),
        F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), None).otherwise(c("l_extendedprice")).alias("price"),
        c("l_discount").alias("discount"),
        c("l_tax").alias("tax"),
        c("l_returnflag").alias("flag"),
        (c("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("is_train"),
    )


def _labelled(t):
    c = F.col
    return t.documents.join(t.labels, "doc_id").select(
        c("doc_id").alias("id"), "text", "lang", c("quality").alias("target"), "toxic", "n_chars"
    )


def _unlabelled(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars")


def _score(col):
    return F.round(d(1) / (d(1) + F.exp(-(F.col(col) - 1500) / d(1500))), 9)


def _pred(t):
    c = F.col
    return t.documents.join(t.labels, "doc_id").select(
        c("doc_id").alias("id"),
        c("quality").alias("y"),
        _score("n_chars").alias("p"),
        c("n_chars").cast("double").alias("x"),
        F.size(F.split("text", " ")).cast("double").alias("words"),
    )


def _scored(t):
    c = F.col
    return t.documents.select(
        c("doc_id").alias("id"), _score("n_chars").alias("p"), c("n_chars").cast("double").alias("x"),
        F.size(F.split("text", " ")).cast("double").alias("words"),
    )


def _texts(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _docstats(t):
    """Per-document measures; the labelled documents are the training part."""
    c = F.col
    known = t.labels.select("doc_id", F.lit(True).alias("known"))
    chars, words = c("n_chars").cast("double"), F.size(F.split("text", " ")).cast("double")
    return t.documents.join(known, "doc_id", "left").select(
        c("doc_id").alias("id"), chars.alias("chars"), words.alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), (chars / words).alias("word_length"),
        "lang", "source", c("known").isNotNull().alias("is_train"),
    )


def _multi(t):
    c = F.col
    return t.part.select(
        c("p_partkey").alias("id"),
        (1 + c("p_size") % 7).cast("double").alias("a"),
        (1 + c("p_partkey") % 5).cast("double").alias("b"),
        (1 + c("p_size") % 3).cast("double").alias("c"),
        (c("p_partkey") % 3).alias("y"),
    )


def _s2s(t):
    c = F.col
    u = t.conversations.where(c("role") == "user").select("conv_id", "turn", c("text").alias("before"))
    a = t.conversations.where(c("role") == "assistant").select(
        "conv_id", (c("turn") - 1).alias("turn"), c("text").alias("after")
    )
    # (conv_id, turn) is the key, so a conversation that holds many rows still spreads over tasks
    return u.join(a, ["conv_id", "turn"]).select((c("conv_id") * 1000 + c("turn")).alias("id"), "before", "after")


def _runs(t):
    c = F.col
    return t.events.select(
        c("user_id").alias("run"),
        c("event_id").alias("step"),
        "ts",
        "event_type",
        (c("value") / d(500)).alias("val_score"),
        (c("value") / d(500) + (c("event_id") % 3) * d(0.1)).alias("train_score"),
        (c("event_id") % 100).cast("double").alias("util"),
        (c("event_type") != "error").alias("success"),
    )


def _logs(t):
    c = F.col
    tail = (
        F.when(c("event_type") == "error", ": CUDA out of memory")
        .when(c("event_type") == "signup", ": No such file x.csv")
        .when(c("event_type") == "view", ": loss is NaN")
        .when(c("event_type") == "click", ": SyntaxError in module")
        .otherwise(" ok")
    )
    return t.events.select(
        c("event_id").alias("id"),
        c("user_id").alias("session"),
        "ts",
        (c("event_id") % 2).cast("int").alias("exit_code"),
        F.concat(
            F.lit("step "), c("event_id").cast("string"), tail, F.lit(" val_score: "),
            F.format_string("%.5f", c("value") / d(500)),
            F.when(c("event_id") % 7 == 0, " Traceback (most recent call last): boom").otherwise(""),
        ).alias("log"),
    )


def _refs(t):
    c = F.col
    ext = F.when(c("lang") == "en", ".jpg").when(c("lang") == "fr", "").when(c("lang") == "de", ".PNG").otherwise(".wav")
    return t.documents.select(c("doc_id").alias("id"), F.concat(F.lit("img_"), c("doc_id").cast("string"), ext).alias("path"))


def _listing(t):
    """Files that exist: one per labelled document, the extension decided by its language."""
    c = F.col
    ext = F.when(c("lang") == "en", ".jpg").when(c("lang") == "fr", ".png").when(c("lang") == "de", ".PNG").otherwise(".wav")
    return t.documents.join(t.labels, "doc_id").select(
        F.concat(F.lit("img_"), c("doc_id").cast("string"), ext).alias("path"), c("n_chars").alias("length")
    )


def _lake(t):
    """File paths of many datasets (one per source and per nation) in the layouts the readers know."""
    c = F.col
    key = c("doc_id").cast("string")
    docs = t.documents.select(
        c("source").alias("dataset"),
        F.when(c("lang") == "en", F.concat(F.lit("train_images/img_"), key, F.lit(".jpg")))
        .when(c("lang") == "fr", F.concat(F.lit("test/part_"), key, F.lit(".csv")))
        .when(c("lang") == "de", F.concat(F.lit("train/part_"), key, F.lit(".csv")))
        .otherwise(F.concat(F.lit("test_images/img_"), key, F.lit(".png"))).alias("path"),
    )
    kind = c("s_suppkey") % 8
    roots = t.supplier.select(
        F.concat(F.lit("nation"), c("s_nationkey").cast("string")).alias("dataset"),
        F.when(kind == 0, "train.csv").when(kind == 1, "training.csv").when(kind == 2, "test.csv")
        .when(kind == 3, "test_data.csv").when(kind == 4, "sample_submission.csv").when(kind == 5, "submission.csv")
        .when(kind == 6, "metadata.json").otherwise("train/train.csv").alias("path"),
    )
    return docs.unionByName(roots)


def _sub(t):
    """A flawed submission: extra ids, null scores and ids that come twice."""
    c = F.col
    base = t.documents.select(
        c("doc_id").alias("id"), F.when(c("lang") == "es", None).otherwise(_score("n_chars")).alias("p")
    )
    again = t.labels.where(c("toxic") == 1).select(c("doc_id").alias("id"), d(0.5).alias("p"))
    return base.unionByName(again)


def _sig(t):
    c = F.col
    return t.embeddings.select(c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("wave"), "label")


VIEWS = {
    "tab": _tab, "names": _names, "items": _items, "labelled": _labelled, "unlabelled": _unlabelled, "pred": _pred, "scored": _scored, "texts": _texts, "docstats": _docstats,
    "multi": _multi, "s2s": _s2s, "runs": _runs, "logs": _logs, "refs": _refs, "listing": _listing, "lake": _lake,
    "sub": _sub, "sig": _sig,
}

_SCORE = "round(1.0::double / (1.0::double + exp(-(n_chars - 1500) / 1500.0::double)), 9)"

VIEW_SQL = {
    "tab": """SELECT o_orderkey AS id,
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price,
        CAST(o_custkey AS DOUBLE) AS cust,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority,
        o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
        o_orderdate < TIMESTAMP '2000-01-01' AS is_train FROM orders""",
    "names": """SELECT c_custkey AS id, c_name AS code, c_mktsegment AS seg,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg_null, c_acctbal AS bal, c_nationkey AS nation
        FROM customer""",
    "items": """SELECT l_orderkey AS order_id, l_quantity AS quantity,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE l_extendedprice END AS price,
        l_discount AS discount, l_tax AS tax, l_returnflag AS flag,
        l_shipdate < TIMESTAMP '2000-01-01' AS is_train FROM lineitem""",
    "labelled": """SELECT d.doc_id AS id, d.text, d.lang, l.quality AS target, l.toxic, d.n_chars
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "unlabelled": """SELECT doc_id AS id, text, lang, n_chars FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "pred": f"""SELECT d.doc_id AS id, l.quality AS y, {_SCORE} AS p, CAST(n_chars AS DOUBLE) AS x,
        CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS words FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "scored": f"""SELECT doc_id AS id, {_SCORE} AS p, CAST(n_chars AS DOUBLE) AS x,
        CAST(len(string_split(text, ' ')) AS DOUBLE) AS words FROM documents""",
    "texts": "SELECT doc_id AS id, text FROM documents",
    "docstats": """SELECT d.doc_id AS id, CAST(n_chars AS DOUBLE) AS chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words,
        CAST(len(string_split(text, chr(10))) AS DOUBLE) AS lines,
        CAST(n_chars AS DOUBLE) / CAST(len(string_split(text, ' ')) AS DOUBLE) AS word_length, lang, source,
        l.doc_id IS NOT NULL AS is_train FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "multi": """SELECT p_partkey AS id, CAST(1 + p_size % 7 AS DOUBLE) AS a, CAST(1 + p_partkey % 5 AS DOUBLE) AS b,
        CAST(1 + p_size % 3 AS DOUBLE) AS c, p_partkey % 3 AS y FROM part""",
    "s2s": """SELECT u.conv_id * 1000 + u.turn AS id, u.text AS before, a.text AS after FROM conversations u
        JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "runs": """SELECT user_id AS run, event_id AS step, ts, event_type, value / 500.0::double AS val_score,
        value / 500.0::double + (event_id % 3) * 0.1::double AS train_score,
        CAST(event_id % 100 AS DOUBLE) AS util, event_type <> 'error' AS success FROM events""",
    "logs": """SELECT event_id AS id, user_id AS session, ts, CAST(event_id % 2 AS INTEGER) AS exit_code,
        concat('step ', event_id, CASE event_type WHEN 'error' THEN ': CUDA out of memory'
          WHEN 'signup' THEN ': No such file x.csv' WHEN 'view' THEN ': loss is NaN'
          WHEN 'click' THEN ': SyntaxError in module' ELSE ' ok' END, ' val_score: ',
          format('{:.5f}', value / 500.0::double),
          CASE WHEN event_id % 7 = 0 THEN ' Traceback (most recent call last): boom' ELSE '' END) AS log FROM events""",
    "refs": """SELECT doc_id AS id, concat('img_', doc_id, CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN ''
        WHEN 'de' THEN '.PNG' ELSE '.wav' END) AS path FROM documents""",
    "listing": """SELECT concat('img_', d.doc_id, CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.png'
        WHEN 'de' THEN '.PNG' ELSE '.wav' END) AS path, n_chars AS length
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "lake": """SELECT source AS dataset, CASE lang WHEN 'en' THEN concat('train_images/img_', doc_id, '.jpg')
        WHEN 'fr' THEN concat('test/part_', doc_id, '.csv') WHEN 'de' THEN concat('train/part_', doc_id, '.csv')
        ELSE concat('test_images/img_', doc_id, '.png') END AS path FROM documents
        UNION ALL SELECT concat('nation', s_nationkey), CASE s_suppkey % 8 WHEN 0 THEN 'train.csv'
        WHEN 1 THEN 'training.csv' WHEN 2 THEN 'test.csv' WHEN 3 THEN 'test_data.csv'
        WHEN 4 THEN 'sample_submission.csv' WHEN 5 THEN 'submission.csv' WHEN 6 THEN 'metadata.json'
        ELSE 'train/train.csv' END FROM supplier""",
    "sub": f"""SELECT doc_id AS id, CASE WHEN lang = 'es' THEN NULL ELSE {_SCORE} END AS p FROM documents
        UNION ALL SELECT doc_id, 0.5::double FROM labels WHERE toxic = 1""",
    "sig": "SELECT vec_id AS id, embedding::DOUBLE[] AS wave, label FROM embeddings",
}
