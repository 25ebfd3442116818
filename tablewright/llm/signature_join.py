"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Each text becomes the set of its word shingles (64-bit hashes) and a signature of COORDINATES minima. Texts with the same
   set are one class from here on.
2. Classes are posted under their (coordinate, value) pairs. Two sets with a similarity of 0.8 agree in at least MATCHES
   coordinates (but for a chance below 1e-6 a pair). So values that one class alone has are skipped, and so are classes with fewer
   than MATCHES values left. Of the rest each class keeps its rarest values, c - MATCHES + 1 of c: two classes that agree
   in MATCHES share one of those.
3. In each posting list the agreeing coordinates are counted; long lists are cut into cells. What agrees enough is
   joined to families, of which only a spanning forest leaves a task.
4. Within families the links are confirmed on the full sets, by merging the shingles' posting lists; again in cells and again
   as forests. Components of the confirmed links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.cells import dealt, each_cell
from tablewright.llm.common import id_type, in_slices, table, whole_text, written
from tablewright.llm.components import Forest, components
from tablewright.llm.registry import query

COORDINATES = 48
MATCHES = 24  # P(binomial(48, 0.8) < 24) is 8e-7
LIST_BLOCK = 400  # classes of a posting list in one block
FAMILY_BLOCK = 500  # classes of a family in one block, or as many as hold
FAMILY_SHINGLES = 1_000_000  # this many shingles

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text: A-Z in lower case, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : n - width + 1 + k]) * _STEP
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each coordinate's hash over each (not empty) set, as 32-bit integers."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        mixed = (flat ^ _FLIP[k]) * _TIMES[k]
        out[:, k] = np.minimum.reduceat(mixed, at) >> np.uint64(32)
    return out.view(np.int32)


def signed(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, mark, sig) of each row; mark names the set; an empty set has no mark and no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                sets, total, first = [], 0, at
                while at < len(texts) and (not sets or total < 300_000):
                    sets.append(shingles(texts[at], size))
                    total += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                rows = iter(signature(full)) if full else iter(())
                marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sig = [next(rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, at - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
                    ["doc_id", "n_shingles", "mark", "sig"],
                )

    rows = df.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(df)}, n_shingles long, mark binary, sig array<int>")


def posted(classes: DataFrame) -> DataFrame:
    """The posting lists: (value, df, rep, n_shingles, sig), each class under its rarest values.

    Spark takes an array for one element and opened rows for as large as the array, so it would hand out tables many times as large as it
    believes: these joins say that both sides are dealt by their key.
    """
    spread = classes.select("rep", F.posexplode("sig").alias("k", "x")).select("rep", (F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("x").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("value"))
    shared = spread.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    mine = spread.join(shared.hint("merge"), "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values")).where(F.size("values") >= MATCHES)
    kept = mine.select("rep", F.explode(F.slice("values", F.lit(1), F.size("values") - (MATCHES - 1))).alias("x")).select("rep", "x.value")
    kept = written(kept, "postings")
    size = kept.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    return kept.join(size.hint("merge"), "value").join(classes.select("rep", "n_shingles", "sig").hint("merge"), "rep")


def family_links(lists: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, per cell, of the classes that agree in enough coordinates and are near enough in size."""

    def compare(t: pa.Table) -> list[tuple[int, int]]:
        rep, n = t.column("rep").to_numpy(), t.column("n_shingles").to_numpy()
        sig = np.asarray(t.column("sig").combine_chunks().flatten(), np.int32).reshape(len(rep), COORDINATES)
        block = t.column("block").to_numpy()
        whole = t.column("cell_i")[0].as_py() == t.column("cell_j")[0].as_py()
        forest = Forest(len(rep))
        split = len(rep) if whole else int(np.searchsorted(block, block[-1]))
        for a in range(split if not whole else len(rep) - 1):
            lo = a + 1 if whole else split
            if forest.parts == 1 or lo >= len(rep):
                break
            same = (sig[lo:] == sig[a]).sum(1)
            near = np.minimum(n[lo:], n[a]) * 100 >= np.maximum(n[lo:], n[a]) * 80
            for b in np.flatnonzero((same >= MATCHES) & near).tolist():
                forest.join(a, lo + b)
        return [(int(rep[a]), int(rep[b])) for a, b in forest.kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in each_cell(batches, "value", compare):
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])

    cells = dealt(lists.select("value", "rep", "n_shingles", "sig", "df"), "value", F.ceil(F.col("df") / LIST_BLOCK), F.col("rep"))
    return cells.mapInArrow(run, "a long, b long")


def confirmed(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): per cell a spanning forest of the rows (family, rep, n_shingles, blocks, text) with 100 * common >= percent * united."""

    def verify(t: pa.Table) -> list[tuple[int, int]]:
        rep, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
        whole = t.column("cell_i")[0].as_py() == t.column("cell_j")[0].as_py()
        split = 0 if whole else int(np.searchsorted(block, block[-1]))
        sets = [shingles(x, size) for x in t.column("text").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        forest = Forest(len(rep))
        who = np.repeat(np.arange(len(rep)), n)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum(count)
        order = np.argsort(code, kind="stable")  # each shingle's rows on end, in row order
        docs = who[order]
        at = np.concatenate([[0], np.cumsum(n)])
        for a in range(len(rep) if whole else split):
            if forest.parts == 1:
                break
            mine = code[at[a] : at[a + 1]]
            mine = mine[count[mine] > 1]
            size_of = count[mine]
            to = np.cumsum(size_of)
            if not len(to):
                continue
            rows = docs[np.arange(to[-1]) + np.repeat(ends[mine] - size_of - (to - size_of), size_of)]
            common = np.bincount(rows, minlength=len(rep))
            linked = 100 * common >= percent * (n + n[a] - common)
            linked[: max(a + 1, split)] = False
            for b in np.flatnonzero(linked).tolist():
                forest.join(a, b)
        return [(int(rep[a]), int(rep[b])) for a, b in forest.kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for links in each_cell(batches, "family", verify):
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])

    cells = dealt(texts.select("family", "rep", "text", "blocks"), "family", F.col("blocks"), F.col("rep"))
    return cells.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Sets of ``size``-word shingles (with fewer words the whole sequence) are linked when 100 * common >= percent * united, for
    ``percent`` of 80 or more. component_id is the smallest doc_id that links reach; kept marks its row. Null or empty texts have no shingles and
    are linked with nothing; rows with a null doc_id are linked with nothing, have a null component_id and are kept. Rows that share a doc_id
    are each judged by their own text; they count as linked where that id is the smallest of both texts' copies. Other columns are ignored. Every group is handled whole: nothing is capped, sampled or left out.
    """
    if percent < 80:
        raise ValueError("the number of matches is set for similarities of 0.8 and more")
    docs = written(signed(df, size), "signed")
    some = docs.where("mark IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(some.groupBy("mark").agg(F.min("doc_id").cast("long").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    family = components(family_links(posted(classes)))
    measured = classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")).join(family, F.col("rep") == F.col("node"))
    blocks = measured.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum("n_shingles") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
    members = written(measured.join(blocks, "component").select("rep", F.col("component").alias("family"), "blocks"), "families")
    texts = df.select("doc_id", whole_text().alias("text")).join(members, F.col("doc_id") == F.col("rep")).select("rep", "family", "blocks", "text")
    groups = components(confirmed(texts, size, percent))
    of_class = classes.join(groups, F.col("rep") == F.col("node"), "left").select("mark", F.coalesce("component", "rep").alias("component_id"))
    of_mark = docs.join(of_class, "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long")))
    return of_mark.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 80 * (m.n + o.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


@query("op5_signature_join", SQL)
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
