"""How far the sources of a language drift apart in their words, over terms that enough documents hold.

Which terms those are is found by iceberg prefix refinement: byte prefixes of the terms are counted by distinct documents, and a
prefix that fewer than the threshold hold is discarded with all terms that begin with it, since none of them can reach
it. Prefixes double in length from level to level until every term left is complete. Terms that are dropped are never
counted, nor sent anywhere, as whole terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, table, whole_text, written
from tablewright.llm.registry import query

#: The scale of shares, and how many terms of a group are reported.
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Bytes of the first level's prefixes.
FIRST_WIDTH = 8
#: Rows that a task sums up before it gives them out.
HELD_ROWS = 2_000_000

#: Every byte that separates terms becomes a blank, A-Z become small letters.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of binary texts, as one array, and how many each text has.

    Separators leave the bytes of all texts at once, so that the terms lie next to each other as an Arrow array wants them.
    """
    wide = pa.types.is_large_binary(texts.type)
    number = np.int64 if wide else np.int32
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, number)[texts.offset : texts.offset + len(texts) + 1] if at else np.zeros(1, number)
    found = FOLD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letter = found != 0x20
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = ends[:-1][ends[:-1] < len(found)]
    first[begins] = letter[begins]  # a text's first letter begins a term, whatever ends the text before
    start, letters = np.flatnonzero(first), np.cumsum(letter, dtype=number)
    offsets = np.append(letters[start] - 1, letters[-1] if len(letters) else 0).astype(number)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(found[letter])]
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(start), buffers), np.diff(np.searchsorted(start, ends))


def summed(rows: np.ndarray) -> np.ndarray:
    """Columns (key, source, n) with equal (key, source) added up, in their order."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    first = np.flatnonzero((np.diff(rows[0], prepend=-1) != 0) | (np.diff(rows[1], prepend=-1) != 0))
    return np.stack([rows[0][first], rows[1][first], np.add.reduceat(rows[2], first)]) if len(first) else rows


def some(rows: np.ndarray, most: int) -> np.ndarray:
    """Columns (key, document) with at most ``most`` distinct documents of a key, in order of the keys."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    rows = rows[:, (np.diff(rows[0], prepend=-1) != 0) | (np.diff(rows[1], prepend=-1) != 0)]
    first = np.flatnonzero(np.diff(rows[0], prepend=-1))
    nth = np.arange(rows.shape[1]) - np.repeat(first, np.diff(np.append(first, rows.shape[1])))
    return rows[:, nth < most]


def mentions(df: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, docs, sources): up to ``min_docs`` documents of a task that hold a term, and how often each source of the task does.

    A document is a row. A task gives one row per language and term for about every HELD_ROWS of what it has summed up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        document = TaskContext.get().partitionId() << 40
        terms: list[pa.Array] = []  # distinct terms of each slice; a term's code is its place in all of them on end
        langs: dict[str, int] = {}
        sources: dict[str, int] = {}
        docs, counts, n_terms = [], [], 0

        def number(names: dict, name: str) -> int:
            return names.setdefault(name, len(names))

        def united() -> tuple[np.ndarray, np.ndarray]:
            """What ``docs`` and ``counts`` hold, summed up under one code for each term."""
            nonlocal terms, n_terms
            found = pa.concat_arrays(terms).dictionary_encode()
            code = found.indices.to_numpy().astype(np.int64)
            terms, n_terms = [found.dictionary], len(found.dictionary)
            for rows in (*docs, *counts):
                rows[0] = rows[0] >> 32 << 32 | code[rows[0] & 0xFFFFFFFF]
            return some(np.concatenate(docs, 1), min_docs), summed(np.concatenate(counts, 1))

        def out(d: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.diff(d[0], prepend=-1))
            key, other = d[0][at], np.flatnonzero(np.diff(c[0], prepend=-1))
            found = pa.StructArray.from_arrays([pa.array(list(sources), pa.string()).take(pa.array(c[1])), pa.array(c[2])], ["source", "n"])
            columns = [
                pa.array(list(langs), pa.string()).take(pa.array(key >> 32)),
                terms[0].take(pa.array(key & 0xFFFFFFFF)).cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.append(at, d.shape[1]), pa.int32()), pa.array(d[1])),
                pa.ListArray.from_arrays(pa.array(np.append(other, c.shape[1]), pa.int32()), found),
            ]
            return pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "sources"])

        for b in in_slices(batches):
            found, sizes = terms_of(b.column("text"))
            found = found.dictionary_encode()
            lang = np.array([number(langs, x) for x in b.column("lang").to_pylist()], np.int64)
            source = np.array([number(sources, x) for x in b.column("source").to_pylist()], np.int64)
            code = found.indices.to_numpy().astype(np.int64) + n_terms
            held, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 32 | code, return_counts=True)
            doc, key = held >> 32, lang[held >> 32] << 32 | held & 0xFFFFFFFF
            if len(key):
                terms.append(found.dictionary.cast(pa.large_binary()))
                n_terms += len(terms[-1])
                docs.append(some(np.stack([key, doc + document]), min_docs))
                counts.append(summed(np.stack([key, source[doc], n])))
            document += len(sizes)
            if sum(c.shape[1] for c in counts) > HELD_ROWS:
                d, c = united()
                docs, counts = [d], [c]
                if c.shape[1] > HELD_ROWS / 2:
                    yield out(d, c)
                    docs, counts, terms, n_terms = [], [], [], 0
                    for names in (langs, sources):
                        names.clear()
        if docs:
            yield out(*united())

    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, term binary, docs array<long>, sources array<struct<source string, n long>>")


def head(width: int) -> Column:
    """The first ``width`` bytes of a term and its end, a zero byte."""
    return F.substring(F.concat(F.col("term"), F.lit(b"\0")), 1, width)


def prefixes(rows: DataFrame, width: int, min_docs: int) -> DataFrame:
    """(lang, head) of the prefixes that at least ``min_docs`` documents hold. A task sends at most ``min_docs`` documents of a prefix."""

    def few(final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs: dict[str, int] = {}
            heads: dict[bytes, int] = {}
            held: list[np.ndarray] = []

            def coded(column: pa.Array, names: dict) -> np.ndarray:
                found = column.dictionary_encode()
                return np.array([names.setdefault(x, len(names)) for x in found.dictionary.to_pylist()], np.int64)[found.indices.to_numpy()]

            def out() -> pa.RecordBatch:
                rows = some(np.concatenate(held, 1), min_docs)
                at = np.flatnonzero(np.diff(rows[0], prepend=-1))
                to = np.append(at, rows.shape[1])
                if final:
                    at = at[np.diff(to) >= min_docs]
                key = rows[0][at]
                columns = [pa.array(list(langs), pa.string()).take(pa.array(key >> 32)), pa.array(list(heads), pa.binary()).take(pa.array(key & 0xFFFFFFFF))]
                if not final:
                    columns.append(pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(rows[1])))
                return pa.RecordBatch.from_arrays(columns, ["lang", "head", "docs"][: len(columns)])

            for b in batches:
                if not b.num_rows:
                    continue
                key = coded(b.column("lang"), langs) << 32 | coded(b.column("head"), heads)
                docs = b.column("docs")
                held.append(some(np.stack([np.repeat(key, np.diff(docs.offsets.to_numpy())), docs.flatten().to_numpy()]), min_docs))
                if len(held) >= 64 and sum(h.shape[1] for h in held[1:]) > held[0].shape[1]:
                    held = [some(np.concatenate(held, 1), min_docs)]
                    if not final and held[0].shape[1] > HELD_ROWS:
                        yield out()
                        held = []
                        langs.clear()
                        heads.clear()
            if held:
                yield out()

        return run

    told = rows.select("lang", head(width).alias("head"), "docs").mapInArrow(few(False), "lang string, head binary, docs array<long>")
    return told.repartition("lang", "head").mapInArrow(few(True), "lang string, head binary")


def kept_terms(told: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of the terms that at least ``min_docs`` documents of ``told`` (lang, term, docs) hold, level by level."""
    width, kept = FIRST_WIDTH, None
    ends = F.substring("head", -1, 1) == F.lit(b"\0")  # the prefix is a whole term and its end
    while True:
        alive = written(prefixes(told, width, min_docs), "prefixes")
        whole = alive.where(ends).select("lang", F.expr("substring(head, 1, octet_length(head) - 1)").alias("term"))
        kept = whole if kept is None else kept.unionByName(whole)
        more = alive.where(~ends)
        if more.isEmpty():
            return kept
        told = written(told.withColumn("head", head(width)).join(more, ["lang", "head"], "left_semi").select("lang", "term", "docs"), "level")
        width *= 2


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly: a long division by thousands, for up to 9e15 counts in a language."""
    whole = total + terms
    value, rest = F.lit(0).cast("long"), n + 1
    for _ in range(3):  # SCALE is 1000 ** 3
        value = value * 1000 + F.call_function("div", rest * 1000, whole)
        rest = rest * 1000 % whole
    return value + 1


def drift(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows so that all rows of a (lang, term) come together; batches hold as many such groups as they can."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        n = rows.num_rows
        last, cut = (rows["lang"][n - 1], rows["term"][n - 1]), n - 1
        while cut and (rows["lang"][cut - 1], rows["term"][cut - 1]) == last:
            cut -= 1
        if cut:
            yield rows.slice(0, cut).combine_chunks().to_batches()[0]
        rest = rows.slice(cut)
    if rest is not None:
        yield rest.combine_chunks().to_batches()[0]


def put_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms that several sources hold, summed per pair of sources: drift(p, q) - drift(p, q0) - drift(p0, q), and how many terms they share.

    A task adds up in a table of pairs, which it gives out whenever that holds HELD_ROWS.
    """
    held: dict[str, dict[str, int]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        pair, more, shared = sums.pop(lang)
        names = pa.array(list(held[lang]), pa.string())
        i, j = pair >> 32, pair & 0xFFFFFFFF
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(pair), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(more), pa.array(shared)], ["lang", "source", "item", "more", "shared"])

    for b in whole_terms(batches):
        every = b.column("lang").to_numpy(zero_copy_only=False)
        source = b.column("source").dictionary_encode()
        source_names, source_of = source.dictionary.to_pylist(), source.indices.to_numpy()
        term, p, p0 = b.column("term").dictionary_encode().indices.to_numpy().astype(np.int64), b.column("p").to_numpy(), b.column("p0").to_numpy()
        for lang in dict.fromkeys(every.tolist()):
            names = held.setdefault(lang, {})
            at = np.flatnonzero(every == lang)
            name = np.array([names.setdefault(x, len(names)) for x in source_names], np.int64)[source_of[at]]
            first = np.flatnonzero(np.diff(term[at], prepend=-1))
            size = np.diff(np.append(first, len(at)))
            a, a0, k, lead = p[at], p0[at], np.repeat(size, size), np.repeat(first, size)  # an entry meets the k entries of its term
            step = max(1, 1_000_000 // int(k.max()))
            for x in range(0, len(at), step):
                n = k[x : x + step]
                i = np.repeat(np.arange(x, min(x + step, len(at))), n)
                j = np.arange(int(n.sum())) + np.repeat(lead[x : x + step] - (np.cumsum(n) - n), n)
                other = i != j
                i, j = i[other], j[other]
                u, v, u0, v0 = a[i], a[j], a0[i], a0[j]
                more = (u - v) * (u - v) // v - (u - v0) * (u - v0) // v0 - (u0 - v) * (u0 - v) // v
                place = name[i] * len(names) + name[j]
                if len(names) ** 2 <= HELD_ROWS:
                    count = np.bincount(place, minlength=len(names) ** 2)
                    total = np.zeros(len(count), np.int64)
                    np.add.at(total, place, more)
                    pair = np.flatnonzero(count)
                    total, count = total[pair], count[pair]
                else:
                    pair, inverse, count = np.unique(place, return_inverse=True, return_counts=True)
                    total = np.zeros(len(pair), np.int64)
                    np.add.at(total, inverse.ravel(), more)
                pair = pair // len(names) << 32 | pair % len(names)
                if lang in sums:
                    pair, total, count = (np.concatenate(v) for v in zip(sums[lang], (pair, total, count), strict=True))
                    pair, inverse = np.unique(pair, return_inverse=True)
                    both = np.zeros((2, len(pair)), np.int64)
                    np.add.at(both[0], inverse.ravel(), total)
                    np.add.at(both[1], inverse.ravel(), count)
                    total, count = both
                sums[lang] = pair, total, count
                if len(pair) > HELD_ROWS:
                    yield out(lang)
    for lang in list(sums):
        yield out(lang)


def audit(df: DataFrame, min_docs: int = 3, top: int | None = TOP_TERMS) -> DataFrame:
    """Drift of the sources of ``df`` (lang, source, text) from each other and of their terms from the language.

    Terms are runs of letters A-Z, made small, and of characters beyond ASCII. A language keeps the V terms that at least ``min_docs`` of its rows
    hold. A group (lang, source) or a whole language gives a kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)), N being all its
    counts of kept terms, and p drifts from q by floor((p - q)^2 / q). Columns: lang, source, part, item, value, rank (from 1 on by value
    descending, then item by its UTF-8 bytes). Part ``pair``: every other source of the language, the drift from its shares, summed over all
    kept terms (0 without any). Part ``term``: the kept terms of the group that it uses more than the language does, the ``top`` first (None:
    all). Null lang, source and text count as empty strings. A document is a row, so repeated rows count each; other columns are
    ignored; groups without terms are in part ``pair`` with a count of 0 for every term; an empty table gives no rows.

    Terms are counted per task before anything is shuffled, and kept terms are paired within a term only as (source, source), as often as
    the pairs are asked for at most.
    """
    groups = written(df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct(), "groups")
    told = written(mentions(df, min_docs), "mentions")
    kept = written(kept_terms(told.select("lang", "term", "docs"), min_docs), "kept-terms")
    of_kept = told.select("lang", "term", "sources").join(kept, ["lang", "term"], "left_semi").repartition("lang", "term")  # the one exchange of whole terms
    counts = of_kept.select("lang", "term", F.inline("sources")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    counts = written(counts.withColumn("n_term", F.sum("n").over(of_term)), "counts")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = F.lit(0).cast("long")
    known = groups.join(totals, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["total", "own", "v"])
    known = known.withColumn("n_lang", F.sum("total").over(Window.partitionBy("lang")))
    known = written(known.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(0)), "group-shares")
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("n_term"), F.col("n_lang"), F.col("v"))
    shares = written(counts.join(known, ["lang", "source"]).select("lang", "source", "term", "p0", p.alias("p"), q.alias("q")), "shares")
    used = shares.where("p > q")
    term = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), drift(F.col("p"), F.col("q")).alias("value"))

    # a pair's sum over all kept terms: those of one source alone against the other's share of no mention, by how often a share occurs;
    # those of both put right for what that took them for; those of none
    sorted_ = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = sorted_.mapInArrow(put_right, "lang string, source string, item string, more long, shared long")
    both = both.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"), F.sum("shared").alias("shared"))
    often = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    left = known.select("lang", "source", "v", "own", "p0")
    right = known.select("lang", F.col("source").alias("item"), F.col("own").alias("own_item"), F.col("p0").alias("q0"))
    pairs = left.join(right, "lang").where("source <> item")
    mine = often.join(right.select("lang", "item", "q0"), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * drift(F.col("p"), F.col("q0"))).alias("mine"))
    theirs = often.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "times").join(left.select("lang", "source", "p0"), "lang").where("source <> item")
    theirs = theirs.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * drift(F.col("p0"), F.col("q"))).alias("theirs"))
    key = ["lang", "source", "item"]
    summed = pairs.join(mine, key, "left").join(theirs, key, "left").join(both, key, "left").na.fill(0, ["mine", "theirs", "more", "shared"])
    none = (F.col("v") - F.col("own") - F.col("own_item") + F.col("shared")) * drift(F.col("p0"), F.col("q0"))
    value = F.when(F.col("v") > 0, F.col("mine") + F.col("theirs") + F.col("more") + none).otherwise(0)
    pair = summed.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    best = ranked(term) if top is None else ranked(term).where(F.col("rank") <= top)
    return ranked(pair).unionByName(best)


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v)::HUGEINT AS p
  FROM grp g JOIN kept k USING (lang) JOIN vs v USING (lang) LEFT JOIN cnt c USING (lang, source, term) LEFT JOIN tot t USING (lang, source)),
ql AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (any_value(total) + any_value(v))::HUGEINT AS q
  FROM cnt JOIN vs USING (lang) JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN ql USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op12_iceberg_audit", SQL)
def op12(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))
