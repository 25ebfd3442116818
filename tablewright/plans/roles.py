"""Queries: column roles, submission format, modality."""

from functools import reduce

from pyspark.sql import functions as F

from tablewright import fixed
from tablewright.operators import files, roles
from tablewright.plans.registry import query


def stacked(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def evidence_sql(role, picks):
    return " UNION ALL ".join(
        f"SELECT '{v}' AS dataset, '{c}' AS {role}_column, count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"count(DISTINCT {c}) AS distinct_values FROM {v}" for v, c in picks
    )


DATASETS = ("tab", "names", "items", "labelled", "runs")


@query("infer_id", evidence_sql("id", [("tab", "id"), ("names", "id"), ("items", "order_id"), ("labelled", "id"), ("runs", "run")]), DATASETS)
def infer_id(t):
    return stacked([roles.column_evidence(df, v, roles.id_column(df.columns), "id") for v in DATASETS for df in [getattr(t, v)]])


@query("infer_target", evidence_sql("target", [("tab", "target"), ("names", "bal"), ("items", "is_train"), ("labelled", "target"), ("runs", "success")]), DATASETS)
def infer_target(t):
    # the sample submission of ``names`` is (id, bal)
    samples = {"names": ["id", "bal"]}
    return stacked([
        roles.column_evidence(df, v, roles.target_column(df.columns, samples.get(v, ())), "target")
        for v in DATASETS for df in [getattr(t, v)]
    ])


@query("infer_submission_id", evidence_sql("id", [("sub", "id"), ("sig", "id"), ("refs", "id"), ("listing", "path")]),
       ("sub", "sig", "refs", "listing"))
def infer_submission_id(t):
    return stacked([
        roles.column_evidence(df, v, roles.submission_id_column(df.columns), "id")
        for v in ("sub", "sig", "refs", "listing") for df in [getattr(t, v)]
    ])


@query("infer_probability", """SELECT 'p' AS "column", min(p) >= 0 AND max(p) <= 1 AS is_probability FROM scored
    UNION ALL SELECT 'x', min(x) >= 0 AND max(x) <= 1 FROM scored UNION ALL SELECT 'words', min(words) >= 0 AND max(words) <= 1 FROM scored""", ("scored",))
def infer_probability(t):
    return roles.probability_columns(t.scored, ["p", "x", "words"])


@query("submission_format", """SELECT 'sub' AS dataset, 'id' AS id_column, 'p' AS prediction_columns,
      CASE WHEN min(p) >= 0 AND max(p) <= 1 THEN 'probability' ELSE 'class' END AS expected_format, count(*) AS num_rows FROM sub
    UNION ALL SELECT 'multi', 'id', 'a,b,c,y', CASE WHEN min(a) >= 0 AND max(a) <= 1 THEN 'probability' ELSE 'class' END,
      count(*) FROM multi
    UNION ALL SELECT 'refs', 'id', 'path', 'class', count(*) FROM refs""", ("sub", "multi", "refs"))
def submission_format(t):
    return stacked([roles.submission_format(getattr(t, v), v) for v in ("sub", "multi", "refs")])


TAGS = ", ".join(f"'{x}'" for x in fixed.NORMALISATION_CLASSES)


@query("text_norm_detect", f"""SELECT 's2s' AS dataset, true AS is_text_normalisation, bool_or(CASE WHEN length(before) > 0 THEN upper('plain') END IN ({TAGS})) AS known_classes,
      count(*) AS rows FROM s2s
    UNION ALL SELECT 'roles', true, bool_or(upper(role) IN ({TAGS})), count(*) FROM conversations
    UNION ALL SELECT 'names', false, false, count(*) FROM names""", ("s2s", "names"))
def text_norm_detect(t):
    tagged = t.s2s.withColumn("class", F.when(F.length("before") > 0, "plain"))
    role = t.conversations.select(F.col("text").alias("input"), F.col("text").alias("output"), F.col("role").alias("class"))
    return stacked([
        roles.text_normalisation(tagged, "s2s"), roles.text_normalisation(role, "roles"), roles.text_normalisation(t.names, "names"),
    ])


MODALITY_SETS = ("refs", "labelled", "unlabelled", "tab", "s2s", "listing", "names")
IMG, AUD = r"'\.(jpg|jpeg|png|bmp|tiff|gif)'", r"'\.(aif|aiff|wav|mp3|flac|ogg|m4a)'"


def any_ext(cols, pattern):
    return "coalesce(" + " OR ".join(f"bool_or(coalesce(regexp_matches(lower({c}), {pattern}), false))" for c in cols) + ", false)"


def heuristic_sql(view, cols, image, text):
    return f"""SELECT '{view}' AS dataset, CASE WHEN {any_ext(cols, AUD)} THEN 'audio'
      WHEN ({image} OR {any_ext(cols, IMG)}) AND {text} THEN 'multimodal' WHEN {image} OR {any_ext(cols, IMG)} THEN 'image'
      WHEN {text} THEN 'text' ELSE 'tabular' END AS heuristic FROM {view}"""


# a column named target (or source, before, after) alone already counts as a sequence table
def sequence_sql(view):
    return f"SELECT '{view}' AS dataset, CASE WHEN count(*) >= 0 THEN 'seq2seq' END AS heuristic FROM {view}"


HEURISTIC_SQL = " UNION ALL ".join([
    heuristic_sql("refs", ["path"], "true", "false"), sequence_sql("labelled"), sequence_sql("tab"), sequence_sql("s2s"),
    heuristic_sql("unlabelled", ["text", "lang"], "false", "true"),
    heuristic_sql("listing", ["path"], "true", "false"), heuristic_sql("names", ["code", "seg", "seg_null"], "false", "false"),
])


def heuristics(t):
    return stacked([roles.heuristic_modality(getattr(t, v), v) for v in MODALITY_SETS])


@query("modality_heuristic", HEURISTIC_SQL, MODALITY_SETS)
def modality_heuristic(t):
    return heuristics(t)


def profile_sql():
    kinds = {"refs": "tabular", "labelled": "tabular", "unlabelled": "tabular", "tab": "tabular", "s2s": "seq2seq", "listing": "tabular", "names": "tabular"}
    rows = [f"SELECT '{v}' AS dataset, '{k}' AS profiled, count(*) AS rows FROM {v}" for v, k in kinds.items()]
    rows.append("SELECT 'pages' AS dataset, 'tabular' AS profiled, count(*) AS rows FROM pages")
    rows.append("""SELECT 'events' AS dataset, CASE WHEN count(*) > 0 THEN 'tabular' END AS profiled, count(*) AS rows FROM events""")
    rows.append("""SELECT 'part' AS dataset, 'tabular' AS profiled, count(*) AS rows FROM part""")
    rows.append("""SELECT 'customer_text' AS dataset, CASE WHEN count(*) > 0 THEN 'text' ELSE 'image' END AS profiled, count(*) AS rows FROM names""")
    rows.append("""SELECT 'timed' AS dataset, 'time_series' AS profiled, count(*) AS rows FROM runs""")
    return " UNION ALL ".join(rows)


def profiles(t):
    sets = [(v, getattr(t, v)) for v in (*MODALITY_SETS, "pages", "events", "part")]
    sets.append(("customer_text", t.names.select("id", "code", "seg", "seg_null")))
    sets.append(("timed", t.runs.select("run", "step", F.col("ts").alias("timestamp"))))
    return stacked([roles.profile_modality(df, v) for v, df in sets])


@query("modality_profile", profile_sql(), (*MODALITY_SETS, "runs"))
def modality_profile(t):
    return profiles(t)


@query("modality_consensus", f"""WITH h AS ({HEURISTIC_SQL}), p AS ({profile_sql()}),
    v AS (SELECT 'listing' AS dataset, bool_and(path IN (SELECT path FROM listing)) AS all_exist FROM listing
      UNION ALL SELECT 'refs', bool_and(path IN (SELECT path FROM listing)) FROM refs)
    SELECT h.dataset, CASE WHEN heuristic = profiled THEN heuristic ELSE profiled END AS modality,
      CASE WHEN heuristic = profiled AND (coalesce(all_exist, true) OR NOT (heuristic IN ('image', 'multimodal')))
        THEN 0.95::double WHEN heuristic = profiled THEN 0.85::double ELSE 0.70::double END AS confidence
    FROM h JOIN p ON h.dataset = p.dataset LEFT JOIN v ON v.dataset = h.dataset""", (*MODALITY_SETS, "runs"))
def modality_consensus(t):
    audits = [
        files.file_audit(getattr(t, v).select("path"), t.listing).select(F.lit(v).alias("dataset"), "all_exist")
        for v in ("refs", "listing")
    ]
    return roles.consensus(heuristics(t), profiles(t), stacked(audits))


ROWS_FROM = 1000  # shorter texts stand for files without rows


@query("dataset_health", f"""WITH n AS (SELECT source AS d, sum(CASE WHEN lang = 'de' AND n_chars > {ROWS_FROM} THEN len(string_split(text, chr(10))) ELSE 0 END) AS trn,
      sum(CASE WHEN lang = 'fr' AND n_chars > {ROWS_FROM} THEN len(string_split(text, chr(10))) ELSE 0 END) AS ten FROM documents GROUP BY 1), l AS (SELECT dataset,
      bool_or(path LIKE 'train/%') AS trd, bool_or(path LIKE 'test/%') AS ted,
      bool_or(path LIKE 'train/%.csv' OR path IN ('train.csv', 'training.csv', 'train_data.csv')) AS trc,
      bool_or(path LIKE 'test/%.csv' OR path IN ('test.csv', 'testing.csv', 'test_data.csv')) AS tec FROM lake GROUP BY 1)
    SELECT dataset, trc AND tec AND coalesce(trn, 0) > 0 AND coalesce(ten, 0) > 0 AS is_valid, concat_ws('; ',
      CASE WHEN NOT trc AND NOT trd THEN 'No training data found in dataset' END,
      CASE WHEN NOT tec AND NOT ted THEN 'No test data found in dataset' END,
      CASE WHEN NOT trc AND NOT trd THEN 'Cannot load train data: No training data found in dataset'
        WHEN NOT trc THEN 'Cannot load train data: No CSV file found in train' WHEN coalesce(trn, 0) = 0 THEN 'Train data is empty' END,
      CASE WHEN NOT tec AND NOT ted THEN 'Cannot load test data: No test data found in dataset'
        WHEN NOT tec THEN 'Cannot load test data: No CSV file found in test' WHEN coalesce(ten, 0) = 0 THEN 'Test data is empty' END) AS issues FROM l LEFT JOIN n ON n.d = l.dataset""", ("lake",))
def dataset_health(t):
    """Rows are the lines of the texts behind the files of each part; a dataset of a nation has files, but no row."""
    lines = F.when(F.col("n_chars") > ROWS_FROM, F.size(F.split("text", "\n"))).otherwise(0)
    per = t.documents.groupBy(F.col("source").alias("dataset")).agg(
        F.sum(F.when(F.col("lang") == "de", lines).otherwise(0)).alias("train_rows"), F.sum(F.when(F.col("lang") == "fr", lines).otherwise(0)).alias("test_rows")
    )
    layout = files.dataset_layout(t.lake).join(per, "dataset", "left")
    return roles.dataset_health(layout.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("train_rows", "test_rows")}))


@query("dataset_info", """SELECT count(*) FILTER (WHERE is_train) AS train_rows, 6 AS train_cols,
    'id,price,cust,priority,status,target' AS train_columns, 'target' AS target_column,
    count(*) FILTER (WHERE NOT is_train) AS test_rows, 5 AS test_cols, 'id,price,cust,priority,status' AS test_columns,
    'id' AS id_column FROM tab""", ("tab",))
def dataset_info(t):
    return roles.dataset_info(t.tab.where("is_train").drop("is_train"), t.tab.where("not is_train").drop("is_train", "target"))
