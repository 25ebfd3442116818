"""URL verdicts from host and path rules: expressions, an equi-join on short hash prefixes, full digests, precedence.

Every URL becomes host-suffix + path-prefix expressions, as many as the rules' shapes ask for (the label counts of their
hosts and the lengths of their paths; no other expression can equal a rule). URLs that agree in these parts are looked up
once. Only DataFrame functions are used.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import table
from tablewright.llm.registry import query

URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHORT = 8  # hexadecimal digits of the digest that the join compares


def url_parts(url):
    """(host, path) columns: host after the first ``://`` with A-Z in lower case, path up to ``?`` or ``#``; else empty."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), ascii_uppercase, ascii_lowercase), F.regexp_extract(url, URL, 2)


def rule_digests(rules: DataFrame) -> DataFrame:
    """(short, digest, rule, rule_verdict, rank) for rows (host, path, verdict). Of equal rules, block holds."""
    whole = F.concat("host", "path")
    ranked = rules.select(whole.alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("host").alias("host_length")).dropna()
    one = ranked.groupBy("rule").agg(F.max_by("rule_verdict", F.col("rule_verdict") == "block").alias("rule_verdict"), F.max("host_length").alias("host_length"))
    digest = F.sha2(F.col("rule").cast("binary"), 256)
    return one.select(
        F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"), "rule", "rule_verdict",
        F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), (F.col("rule_verdict") == "block").alias("c"), "rule").alias("rank"),
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains when the URL's path starts with the rule's; the longest
    rule wins, then the longer host, then block. Without a rule: null and ``default``. A null URL, or one without ``://``, has empty
    host and path. Rules with a null part are left out; an empty rule table leaves every URL at ``default``. Repeated rows and null ids are
    kept; other columns are ignored. The label counts and path lengths of the rules are brought to the driver (a few small
    numbers); rules are joined by hash, so either table may be large. A URL shape that many rows share is one key
    of a left join, which adaptive execution splits.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = rules.dropna(subset=["host", "path", "verdict"])
    shape = known.agg(F.collect_set(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    if not labels:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("tail", F.substring_index("host", ".", -labels[-1])).withColumn("head", F.substring("path", 1, lengths[-1]))
    seen = rows.select("tail", "head").distinct()
    parts = F.split("tail", r"\.", -1)
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= k, F.substring_index("tail", ".", -k)) for k in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths]))
    expressions = (
        seen.select("tail", "head", F.explode(F.array_distinct(suffixes)).alias("suffix"), prefixes.alias("prefixes"))
        .select("tail", "head", "suffix", F.explode("prefixes").alias("prefix"))
        .select("tail", "head", F.sha2(F.concat("suffix", "prefix").cast("binary"), 256).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    fits = expressions.join(rule_digests(known), "short").where(F.col("full") == F.col("digest"))
    best = fits.groupBy("tail", "head").agg(F.max_by(F.struct("rule", "rule_verdict"), "rank").alias("best"))
    return rows.join(best, ["tail", "head"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )


def _sql() -> str:
    host = f"translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{ascii_uppercase}', '{ascii_lowercase}')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH r(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages)
SELECT page_id, host, path,
  (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM u"""


@query("op3_url_rules", _sql())
def op3(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
