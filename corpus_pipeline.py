"""Documents to token digests: toxicity, near-duplicates, benchmark leaks, secrets, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet and rereads them as the next one's docs. Rows with a null text count as
empty texts; rows with a null doc_id cannot be near-duplicates and stay there, other stages judge them like all; of rows that repeat a doc_id and text the
near-duplicates stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, secret_index, signature_join, toxic_lexicon, transducer
from tablewright.llm.common import table, whole_text, written

#: No SQL: a learned lexicon, local alignment and BPE. tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids``, a written table that Spark broadcasts only if it measures it to be small."""
    return docs.join(written(ids.select("doc_id").distinct(), "rejected"), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity below 0.7; the lexicon is learned from the labelled ones that are not held out."""
    lexicon = toxic_lexicon.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return toxic_lexicon.scored(rows, lexicon, "row").where("score < 0.7").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id, of its repeated rows the largest."""
    kept = without(docs, signature_join.near_duplicates(docs, size=5, percent=80).where("NOT kept"))
    several = written(kept.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    order = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]  # maps have no order of their own
    same = kept.join(several, "doc_id", "left_semi").groupBy("doc_id", whole_text().alias("whole")).agg(F.max_by(F.struct(*docs.columns), F.struct(*order)).alias("row"))
    return kept.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(same.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no copy of a benchmark item, exact or edited; rows without a doc_id get numbers of their own to be judged by."""
    items = table(spark, sf_dir, "benchmark")
    kept = without(docs, decontaminate.contaminated(docs, items))
    unnamed = docs.where("doc_id IS NULL")
    if unnamed.isEmpty():
        return kept
    numbered = written(unnamed.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")), "unnamed")
    leaks = decontaminate.contaminated(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), items)
    clean = numbered.join(written(leaks.select(F.col("doc_id").alias("number")).distinct(), "rejected"), "number", "left_anti")
    return kept.where("doc_id IS NOT NULL").unionByName(clean.select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts masked and n_chars of the masked text."""
    found = secret_index.find(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    text = F.when(F.size("secrets") > 0, secret_index.masked(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("secrets") > 0, size).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return transducer.round_trip_digests(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
