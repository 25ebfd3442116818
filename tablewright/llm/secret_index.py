"""Secrets found through a trigram inverted index; only DataFrame functions run over the documents.

Each rule is a regular expression. From it follow Boolean conditions on the trigrams of a matching text (lower case): a
list of clauses that all hold, each a list of alternatives, each a set of trigrams that are all there. The index holds
(trigram, doc_id) for the trigrams that rules ask for. Postings are intersected per rule, and only the candidates that
remain are searched with the expression. A rule whose expression has no mandatory trigram is searched in every text.
"""

from __future__ import annotations

import re._constants as sre
from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import table, whole_text, written
from tablewright.llm.registry import query

MOST = 64  # strings that a part of an expression is spelled out to; beyond, the part asks for no trigram


@dataclass(frozen=True)
class Rule:
    """kind, expression, and the group whose match needs ``least`` characters (shorter matches are dropped)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: The base rules, in their order. ``AKIA[A-Z0-9]+`` of 16 characters and ``[0-9a-f]+`` of 32 are written with their lengths: a run is
#: matched whole or not at all, so the matches are the same, and short runs, of which texts are full, make no rows.
BASE = [
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
]
#: Rules that the method adds: public formats of keys and tokens.
ADDED = [
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge_token", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
]
RULES = BASE + ADDED

Alternatives = list[frozenset[str]]


def trigram_query(pattern: str) -> list[Alternatives]:
    """The clauses that hold for every text with a match of ``pattern``; none if no trigram is mandatory."""
    clauses: list[Alternatives] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((g for g in grams if not any(h < g for h in grams)), key=sorted))

    def spelled(items) -> set[str] | None:
        """All strings that a sequence matches, if they are few."""
        out = {""}
        for item in items:
            found = one(item)
            if found is None or len(out) * len(found) > MOST:
                return None
            out = {a + b for a, b in product(out, found)}
        return out

    def one(item) -> set[str] | None:
        op, value = item
        if op is sre.LITERAL:
            return {chr(value).lower()}
        if op is sre.IN and all(x[0] is sre.LITERAL for x in value):
            return {chr(x[1]).lower() for x in value}
        if op is sre.SUBPATTERN:
            return spelled(value[-1])
        if op is sre.BRANCH:
            parts = [spelled(b) for b in value[1]]
            return None if None in parts or sum(map(len, parts)) > MOST else set().union(*parts)
        if op is sre.MAX_REPEAT and value[1] is not sre.MAXREPEAT and value[1] <= 5:
            inner = spelled(value[2])
            if inner is None:
                return None
            out: set[str] = set()
            for n in range(value[0], value[1] + 1):
                if len(inner) ** n > MOST:
                    return None
                out |= {"".join(x) for x in product(inner, repeat=n)}
            return out
        return None

    def walk(items) -> None:
        run: set[str] = {""}
        for item in items:
            found = one(item)
            if found is not None and len(run) * len(found) <= MOST:
                run = {a + b for a, b in product(run, found)}
                continue
            close(run)
            run = found if found is not None else {""}
            op, value = item
            if found is None and op is sre.SUBPATTERN:
                walk(value[-1])
            elif found is None and op is sre.MAX_REPEAT and value[0] > 0:
                walk(value[2])
        close(run)

    walk(_parser.parse(pattern))
    return clauses


def index(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The inverted index (gram, doc_id) over whole texts, written below the shared folder, for the trigrams rules ask for."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for alt in clause for g in alt})
    folded = df.select("doc_id", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return written(folded.select(F.explode(held).alias("gram"), "doc_id").distinct(), "trigram-index")


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, kinds): for each document the rules whose clauses its postings fulfil; none for full-scan rules.

    The postings of a rule's trigrams are intersected by counting, per document and alternative, the trigrams found.
    """
    need = [
        (r.kind, c, a, g, len(alt), len(clauses))
        for r in rules for clauses in [trigram_query(r.pattern)] for c, clause in enumerate(clauses) for a, alt in enumerate(clause) for g in sorted(alt)
    ]
    wanted = postings.sparkSession.createDataFrame(need, "kind string, clause int, alternative int, gram string, n_grams int, n_clauses int")
    met = (
        postings.join(F.broadcast(wanted), "gram")  # as large as the rule list
        .groupBy("doc_id", "kind", "clause", "alternative", "n_grams", "n_clauses").agg(F.count("*").alias("n"))
        .where("n = n_grams")
        .groupBy("doc_id", "kind", "n_clauses").agg(F.count_distinct("clause").alias("n")).where("n = n_clauses")
    )
    return written(met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), "secret-candidates")


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


BLOCK = 256


def running(sizes: Column) -> Column:
    """Running sums of an array of integers, block by block, so that long arrays cost little more than their length."""

    def sums(values: Column) -> Column:
        grow = lambda done, x: F.concat(done, F.array(x + F.coalesce(F.get(done, F.size(done) - 1), F.lit(0))))
        return F.aggregate(values, F.array().cast("array<int>"), grow)

    def cut(all_sizes: Column) -> Column:
        last = F.floor((F.size(all_sizes) - 1) / F.lit(BLOCK)).cast("int")
        return F.when(F.size(all_sizes) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_sizes, b * BLOCK + 1, F.lit(BLOCK))))

    def shifted(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(e, i - 1), F.lit(0))))))

    found = let(sizes, lambda s: let(F.transform(cut(s), sums), shifted))
    return F.coalesce(found, F.array().cast("array<int>"))


SPANS = "array<struct<start:int,place:int,kind:string,stop:int,n:int>>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """The matches of a rule that are long enough, as (start, place, kind, stop, n): code points, end exclusive.

    Positions are running sums over the pieces between matches and the matches.
    """

    def matches(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))

    def located(own: Column) -> Column:
        needed = F.transform(matches(rule.group), F.length) if rule.group else own
        pieces = F.slice(F.transform(F.split(text, rule.pattern, -1), F.length), 1, F.size(own))
        both = F.zip_with(own, needed, lambda a, b: F.struct(a.alias("own"), b.alias("n")))
        stops = running(F.zip_with(pieces, own, lambda a, b: a + b))
        rows = F.zip_with(both, stops, lambda x, stop: F.struct(
            (stop - x["own"]).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), stop.alias("stop"), x["n"].alias("n")))
        return F.filter(rows, lambda x: x["n"] >= rule.least)

    own = F.transform(matches(0), F.length)
    return let(own, lambda o: F.when(F.size(o) > 0, located(o)).otherwise(F.array().cast(SPANS)))


def find(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` with ``secrets``: array<struct<start, place, kind, stop, n>> by start, then place of the rule.

    Needs doc_id and text; other columns are kept, a column named ``secrets`` is replaced. A null text has no secrets. Rows that share
    a doc_id, also a null one, share their candidates and are searched each on its own. Whole texts are searched.
    The candidates are a written table; Spark broadcasts it only if its measured size is below the session's limit, else
    both sides are shuffled by doc_id.
    """
    df = df.drop("secrets", "kinds")
    found = candidates(index(df, rules), rules)
    text = whole_text()
    joined = df.join(found.withColumnRenamed("doc_id", "candidate_id"), F.col("doc_id").eqNullSafe(F.col("candidate_id")), "left")
    per_rule = []
    for place, rule in enumerate(rules):
        spans = spans_of(text, rule, place)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(F.array().cast(SPANS))
        per_rule.append(spans)
    return joined.withColumn("secrets", F.array_sort(F.concat(*per_rule))).drop("candidate_id", "kinds")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def masked(text: Column, secrets: Column) -> Column:
    """The text with each secret replaced by its kind in brackets; what overlaps an earlier one goes with it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(done, x):
        piece = F.substring(text, done["at"] + 1, x["start"] - done["at"])
        later = F.greatest(done["at"], x["stop"]).alias("at")
        grown = F.when(x["start"] >= done["at"], F.concat(done["out"], F.array(F.concat(piece, F.lit("["), x["kind"], F.lit("]"))))).otherwise(done["out"])
        return F.struct(later, grown.alias("out"))

    pieces = F.aggregate(secrets, start, cut, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, pieces).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of the rows that ``find`` returns."""
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["place"] < len(BASE))
    return found.select(
        "doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def _sql() -> str:
    def literal(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    union = " UNION ALL ".join(
        f"SELECT n, {place} AS place, '{r.kind}' AS kind, m, g, pieces, unnest(range(1, len(m) + 1)) AS i FROM (SELECT n, regexp_extract_all(t, {p}, 0) AS m, "
        f"regexp_extract_all(t, {p}, {r.group}) AS g, string_split_regex(t, {p}) AS pieces FROM d)"
        for place, r in enumerate(RULES) for p in [literal(r.pattern)]
    )
    least = " ".join(f"WHEN {place} THEN {r.least}" for place, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({union}),
s AS (SELECT n, place, kind,
  coalesce(list_sum(list_transform(pieces[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda v: length(v))), 0) AS a,
  length(m[i]) AS size FROM x WHERE length(g[i]) >= CASE place {least} END),
l AS (SELECT n, place, a, kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS w FROM s),
o AS (SELECT n, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
  coalesce(string_agg(w, ',' ORDER BY a, place) FILTER (place < {len(BASE)}), '') AS base, string_agg(w, ',' ORDER BY a, place) AS spans FROM l GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (n)"""


@query("op2_secret_index", _sql())
def op2(spark, sf_dir):
    return report(find(table(spark, sf_dir, "documents").select("doc_id", "text")))
