"""Queries: sources, sinks, file listings."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import fixed
from tablewright.functions.strings import described_metric, described_task
from tablewright.operators import files, sampling
from tablewright.plans.registry import query
from tablewright.session import scratch
from tablewright.sources import readers, writers

TAB_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("cust", T.DoubleType()),
    T.StructField("priority", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("target", T.LongType()), T.StructField("is_train", T.BooleanType()),
])
TAB_SQL = "SELECT id, price, cust, priority, status, CAST(target AS BIGINT) AS target, is_train FROM tab"


@query("scan_csv", TAB_SQL.replace("SELECT id,", "SELECT id, 9000000000000000001 + id * 1000003 AS wide_id,"), ("tab",))
def scan_csv(t):
    wide = (F.lit(9000000000000000001) + F.col("id") * 1000003).alias("wide_id")
    return readers.read_csv(t.spark, writers.write_csv(t.tab.select("*", wide), scratch(t.spark, "scan_csv")))


@query("scan_csv_safe", TAB_SQL, ("tab",))
def scan_csv_safe(t):
    good = writers.write_csv(t.tab, scratch(t.spark, "scan_csv_safe"))
    absent = scratch(t.spark, "absent")
    return readers.read_csv_safe(t.spark, good, TAB_SCHEMA).unionByName(readers.read_csv_safe(t.spark, absent, TAB_SCHEMA))


@query("scan_preview", "SELECT * FROM tab ORDER BY id LIMIT 5", ("tab",))
def scan_preview(t):
    return readers.preview(t.tab, "id", 5)


@query("scan_text_head", """SELECT item_id % 16 AS part, string_agg(text || chr(10), '' ORDER BY item_id) AS text,
    CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM benchmark GROUP BY 1""")
def scan_text_head(t):
    """Sixteen files, each read whole: the items of a part in the order of their ids."""
    path = scratch(t.spark, "texts")
    parts = t.benchmark.withColumn("part", F.col("item_id") % 16)
    parts.repartition(16, "part").sortWithinPartitions("part", "item_id").select("part", "text").write.partitionBy("part").text(path)
    found = readers.read_texts(t.spark, path)
    return found.select(
        F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "text", F.length("text").cast("long").alias("n_chars")
    )


@query("describe_metric", """SELECT doc_id,
    CASE WHEN s LIKE '%auc%' OR s LIKE '%roc%' THEN 'AUC-ROC' WHEN s LIKE '%accuracy%' THEN 'accuracy'
      WHEN s LIKE '%rmse%' OR s LIKE '%root mean squared%' THEN 'RMSE'
      WHEN s LIKE '%mae%' OR s LIKE '%mean absolute%' THEN 'MAE'
      WHEN s LIKE '%log loss%' OR s LIKE '%logloss%' THEN 'log_loss' WHEN s LIKE '%f1%' THEN 'F1' END AS metric,
    CASE WHEN s LIKE '%classification%' OR s LIKE '%binary%' THEN 'classification'
      WHEN s LIKE '%regression%' THEN 'regression' WHEN s LIKE '%segmentation%' THEN 'segmentation' END AS task
    FROM (SELECT doc_id, lower(text) AS s FROM documents)""")
def describe_metric(t):
    c = F.col("text")
    return t.documents.select("doc_id", described_metric(c).alias("metric"), described_task(c).alias("task"))


@query("scan_json_runs", "SELECT run, step, val_score, success FROM runs", ("runs",))
def scan_json_runs(t):
    path = writers.write_json(t.runs.select("run", "step", "val_score", "success"), scratch(t.spark, "runs"))
    return readers.read_json_rows(t.spark, path, "run long, step long, val_score double, success boolean")


@query("scan_json_array", "SELECT run, step, val_score, success FROM runs", ("runs",))
def scan_json_array(t):
    """Result lists: JSON arrays of the runs of a thousand steps each, one array per line."""
    entry = F.struct("run", "step", "val_score", "success")
    lists = t.runs.groupBy("run", F.floor(F.col("step") / 1000).alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    path = scratch(t.spark, "run_lists")
    lists.select("value").write.text(path)
    return readers.read_json_rows(t.spark, path, "run long, step long, val_score double, success boolean")


SINK_NAME = writers.submission_name("20240131_120000", "baseline", 42)


@query("sink_csv", f"SELECT id, p, '{SINK_NAME}' AS name FROM scored", ("scored",))
def sink_csv(t):
    path = writers.write_csv(t.scored.select("id", "p"), f"{scratch(t.spark, 'sink_csv')}/{SINK_NAME}")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.DoubleType())])
    return readers.read_csv(t.spark, path, schema).withColumn("name", F.lit(path.rsplit("/", 1)[1]))


def seed_reports(t):
    """One nested report per competition: counts, medals and one entry per seed (three seeds)."""
    seeds = t.runs.groupBy(F.col("event_type").alias("competition"), (F.col("run") % 3).alias("seed")).agg(
        F.count("*").alias("runs"), F.max("val_score").alias("best"), F.count_if(F.col("val_score") >= 0.9).alias("medals")
    )
    return seeds.groupBy("competition").agg(
        F.struct(F.sum("runs").alias("runs"), F.sum("medals").alias("medals")).alias("totals"),
        F.array_sort(F.collect_list(F.struct("seed", "best", "medals"))).alias("results"),
    )


@query("sink_json", """SELECT event_type AS competition, run % 3 AS seed, max(val_score) AS best,
    count(*) FILTER (WHERE val_score >= 0.9) AS medals,
    CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS total_runs
    FROM runs GROUP BY 1, 2""", ("runs",))
def sink_json(t):
    path = writers.write_json(seed_reports(t), scratch(t.spark, "reports"))
    schema = ("competition string, totals struct<runs: long, medals: long>, "
              "results array<struct<seed: long, best: double, medals: long>>")
    got = readers.read_json_rows(t.spark, path, schema)
    return got.select("competition", F.col("totals.runs").alias("total_runs"), F.inline("results"))


@query("trace_log", """SELECT 'action' AS type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, id, 'execution' AS phase,
      CAST(exit_code AS BIGINT) AS exit_code, CAST(NULL AS VARCHAR) AS selected, session FROM logs
    UNION ALL SELECT 'decision', strftime(ts, '%Y-%m-%dT%H:%M:%S'), id, NULL, NULL,
      CASE WHEN exit_code <> 0 THEN 'retry' ELSE 'accept' END, session FROM logs
    UNION ALL SELECT 'improvement', strftime(ts, '%Y-%m-%dT%H:%M:%S'), id, NULL, NULL, 'keep', session FROM logs WHERE exit_code = 0
    UNION ALL SELECT 'session', strftime(min(ts), '%Y-%m-%dT%H:%M:%S'), NULL, NULL, NULL, NULL, session FROM logs GROUP BY session""", ("logs",))
def trace_log(t):
    """A header per session, then its actions, decisions and improvements."""
    path, c = scratch(t.spark, "trace"), F.col
    header = t.logs.groupBy("session").agg(F.min("ts").alias("ts"))
    writers.append_trace(writers.trace_entries(header, "session", c("ts"), session=c("session")), path)
    better = t.logs.where("exit_code = 0")
    writers.append_trace(writers.trace_entries(better, "improvement", c("ts"), id=c("id"), selected=F.lit("keep"), session=c("session")), path)
    action = writers.trace_entries(t.logs, "action", c("ts"), phase=F.lit("execution"), id=c("id"), exit_code=c("exit_code"), session=c("session"))
    choice = F.when(c("exit_code") != 0, "retry").otherwise("accept")
    decision = writers.trace_entries(t.logs, "decision", c("ts"), id=c("id"), selected=choice, session=c("session"))
    writers.append_trace(action, path)
    writers.append_trace(decision, path)
    got = readers.read_json_rows(t.spark, path, "type string, timestamp string, payload string")
    body = F.from_json("payload", "phase string, id long, exit_code long, selected string, session long")
    return got.select("type", "timestamp", body.alias("b")).select("type", "timestamp", "b.*")


@query("subset_dataset", """SELECT part, id FROM (SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, id,
      row_number() OVER (PARTITION BY is_train ORDER BY md5(concat(id, ':42')), id) AS r,
      round_even(0.1 * count(*) OVER (PARTITION BY is_train), 0) AS n FROM tab) WHERE r <= n
    UNION ALL SELECT 'sample_submission', id FROM (SELECT id,
      row_number() OVER (ORDER BY md5(concat(id, ':42')), id) AS r,
      round_even(0.1 * count(*) OVER (), 0) AS n FROM tab WHERE NOT is_train) WHERE r <= n""", ("tab",))
def subset_dataset(t):
    base = scratch(t.spark, "subset")
    train = sampling.sample_fraction(t.tab.where("is_train"), "id", 0.1, 42)
    test = sampling.sample_fraction(t.tab.where("not is_train"), "id", 0.1, 42)
    writers.write_csv(train, f"{base}/train")
    writers.write_csv(test, f"{base}/test")
    template = t.tab.where("not is_train").select("id", F.lit(0.5).alias("target"))
    kept = template.join(readers.read_csv(t.spark, f"{base}/test", TAB_SCHEMA).select("id"), "id", "left_semi")
    writers.write_csv(kept, f"{base}/sample_submission")
    ids = T.StructType([T.StructField("id", T.LongType()), T.StructField("target", T.DoubleType())])
    parts = [("train", TAB_SCHEMA), ("test", TAB_SCHEMA), ("sample_submission", ids)]
    frames = [readers.read_csv(t.spark, f"{base}/{p}", s).select(F.lit(p).alias("part"), "id") for p, s in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


LAYOUT_SQL = """SELECT dataset,
  CASE WHEN bool_or(path LIKE 'train/%') THEN 'train' END AS train_path,
  CASE WHEN bool_or(path LIKE 'test/%') THEN 'test' END AS test_path,
  coalesce(min(path) FILTER (WHERE path LIKE 'train/%.csv' AND path NOT LIKE 'train/%/%'),
    arg_min(path, CASE path WHEN 'train.csv' THEN 1 WHEN 'training.csv' THEN 2 WHEN 'train_data.csv' THEN 3 END)
      FILTER (WHERE path IN ('train.csv', 'training.csv', 'train_data.csv'))) AS train_csv,
  coalesce(min(path) FILTER (WHERE path LIKE 'test/%.csv' AND path NOT LIKE 'test/%/%'),
    arg_min(path, CASE path WHEN 'test.csv' THEN 1 WHEN 'testing.csv' THEN 2 WHEN 'test_data.csv' THEN 3 END)
      FILTER (WHERE path IN ('test.csv', 'testing.csv', 'test_data.csv'))) AS test_csv,
  CASE WHEN bool_or(regexp_matches(path, '^train_images/[^/]*\\.(jpg|png|jpeg)$')) THEN 'train_images' END AS train_images_dir,
  CASE WHEN bool_or(regexp_matches(path, '^test_images/[^/]*\\.(jpg|png|jpeg)$')) THEN 'test_images' END AS test_images_dir,
  arg_min(path, CASE path WHEN 'sample_submission.csv' THEN 1 ELSE 2 END)
    FILTER (WHERE path IN ('sample_submission.csv', 'submission.csv')) AS sample_submission,
  min(path) FILTER (WHERE path = 'metadata.json') AS metadata_file,
  CASE WHEN bool_or(regexp_matches(path, '^train_images/[^/]*\\.(jpg|png|jpeg)$')) THEN 'image_dataset'
    WHEN bool_or(path LIKE 'train/%') THEN 'folder_structure'
    WHEN bool_or(path IN ('train.csv', 'training.csv', 'train_data.csv')) THEN 'flat_csv' ELSE 'unknown' END AS structure_type
  FROM lake GROUP BY dataset"""


@query("dataset_layout", LAYOUT_SQL, ("lake",))
def dataset_layout(t):
    return files.dataset_layout(t.lake)


FOLDER_SQL = "CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"


@query("first_file", f"""SELECT dataset, {FOLDER_SQL} AS folder, min(path) AS first_path FROM lake
    WHERE path LIKE '%.csv' GROUP BY 1, 2""", ("lake",))
def first_file(t):
    return files.first_file(t.lake)


@query("image_dirs", f"""SELECT dataset, {FOLDER_SQL} AS folder, count(*) AS images FROM lake
    WHERE regexp_matches(lower(path), '\\.(jpg|png|jpeg)$') GROUP BY 1, 2""", ("lake",))
def image_dirs(t):
    return files.image_dirs(t.lake)


@query("missing_inputs", """SELECT dataset, folder FROM (SELECT DISTINCT source AS dataset FROM documents UNION SELECT concat('nation', n_nationkey) FROM nation
      UNION SELECT concat('region', r_regionkey) FROM region), (SELECT unnest(['train', 'test']) AS folder)
    EXCEPT SELECT dataset, split_part(path, '/', 1) FROM lake""", ("lake",))
def missing_inputs(t):
    """Expected are all sources, nations and regions; regions have no file at all."""
    expected = t.documents.select(F.col("source").alias("dataset")).union(t.nation.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"))))
    expected = expected.union(t.region.select(F.concat(F.lit("region"), F.col("r_regionkey").cast("string"))))
    return files.missing_inputs(t.lake, expected, ["train", "test"])


@query("file_audit", """SELECT bool_and(l.path IS NOT NULL) AS all_exist,
    (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM refs WHERE path NOT IN (SELECT path FROM listing)
      ORDER BY path LIMIT 10)) AS missing_files,
    count(*) AS total_files, count(l.path) AS verified_files FROM refs r LEFT JOIN listing l ON r.path = l.path""",
       ("refs", "listing"))
def file_audit(t):
    return files.file_audit(t.refs, t.listing)


@query("resolve_paths", r"""WITH m AS (SELECT id, path, CASE WHEN regexp_matches(path, '\.(jpg|jpeg|png|bmp|tiff)$')
      THEN path ELSE concat(path, '.jpg') END AS main FROM refs),
    c AS (SELECT id, path, main AS candidate, 0 AS pr FROM m
      UNION ALL SELECT id, path, concat(regexp_replace(main, '\.[^.]*$', ''), e.ext), e.pr FROM m,
        (VALUES ('.jpg', 1), ('.jpeg', 2), ('.png', 3), ('.JPG', 4), ('.JPEG', 5), ('.PNG', 6)) e(ext, pr))
    SELECT c.id, c.path, arg_min(l.path, pr) FILTER (WHERE l.path IS NOT NULL) AS resolved
    FROM c LEFT JOIN listing l ON l.path = c.candidate GROUP BY 1, 2""", ("refs", "listing"))
def resolve_paths(t):
    return files.resolve_paths(t.refs, t.listing)


@query("path_like_columns", """SELECT 'path' AS "column",
      bool_or(regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|tiff|gif)')) AS path_like FROM refs""", ("refs",))
def path_like_columns(t):
    return files.path_like_columns(t.refs, fixed.IMAGE_EXTENSIONS)


@query("path_parts", r"""SELECT id, path, CASE WHEN path LIKE '%.%' THEN regexp_replace(path, '\.[^.]*$', '') ELSE path END AS stem,
    CASE WHEN path LIKE '%.%' THEN regexp_extract(path, '\.([^.]*)$', 1) ELSE '' END AS extension FROM refs""", ("refs",))
def path_parts(t):
    return files.path_parts(t.refs)
