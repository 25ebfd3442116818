"""Benchmark decontamination: n-gram seeds join training passages to test items, Smith-Waterman scores the copies.

1. Seeds are words of an item in order, not all of them neighbours: three with at most two others between (``SHAPES``). Every seed
   of an item is kept, however common, so an edit only takes away the seeds that it touches.
2. The documents are read once for seeds. Seeds near each other make a passage, wide enough for the longest copy on either side.
3. Passages are joined to items on seeds. A pair goes on if it shares as many seeds as the threshold makes necessary (``needed``).
4. A local alignment of words scores each (passage, item): edits, insertions and deletions cost, order counts.

Nothing is lost before step 4. Of M matched words and a cost of X outside them, 2 M - X >= 2 t n for an item of n words and the threshold t.
The M - 2 triples of successive matches have a cost of at most 2 X within them, so at most 2 X / 3 of them cost 3 or more: at
least ((4 t - 1) n - 6) / 3 cost at most 2, and these are seeds of both sides. Items too short for that use pairs with at most one other
word between, of which t n - 1 are left, and single words in the end. Reading looks n-grams up in a bit table of fixed size, which can only let
too many through; the join is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import id_type, in_slices, table, whole_text, written
from tablewright.llm.registry import query

GRAM = 3
#: By the number of words of a seed: the places of its words after the first.
SHAPES = {1: [()], 2: [(1,), (2,)], 3: [(1, 2), (2, 3), (1, 3), (3, 4), (2, 4), (1, 4)]}
WIDEST = 5  # words that a seed spans
BITS = 24  # of the bit table, two marks for each seed: 16 million places, two megabytes
MATCH, MISMATCH, GAP = 2, -1, -1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CLEAN = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))


def words_of(text: str) -> list[bytes]:
    """Words in lower case; ASCII signs and white space part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def needed(n: int, threshold: float) -> tuple[int, int]:
    """(words of a seed, seeds that any copy with at least ``threshold`` of the item's score shares) for an item of ``n`` words."""
    for size, least in ((3, ((4 * threshold - 1) * n - 6) / 3), (2, threshold * n - 1)):
        if math.ceil(least - 1e-9) >= 1:
            return size, math.ceil(least - 1e-9)
    return 1, 1


def widest_copy(n: int, threshold: float) -> int:
    """Words that a copy of an item of ``n`` words can span: all of its words and as many others as the threshold leaves."""
    return math.ceil(n * (1 + MATCH * max(0.0, 1 - threshold)) - 1e-9)


def grams_of(words: list[bytes], size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds of ``size`` words, and where each begins."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for shape in SHAPES[size]:
        m = n - (shape[-1] if shape else 0)
        if m <= 0:
            continue
        out = h[:m]
        for k in shape:
            out = (out * _STEP) ^ h[k : m + k]
            out ^= out >> np.uint64(29)
        grams.append(out * _STEP)
        places.append(np.arange(m))
    return np.concatenate(grams), np.concatenate(places)


def item_grams(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, place, gram, size, need, n_words): all seeds of the test items, once each; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            rows, found, kinds = [], [], []
            for r, w in enumerate(words):
                if w:
                    size, need = needed(len(w), threshold) if len(w) >= GRAM else (len(w), 1)
                    found.append(grams_of(w, size))
                    rows.append(np.full(len(found[-1][0]), r))
                    kinds.append(np.tile([size, need, len(w)], (len(rows[-1]), 1)))
            if found:
                kind = np.concatenate(kinds)
                yield pa.RecordBatch.from_arrays(
                    [b.column("item_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate([p for _, p in found])),
                     pa.array(np.concatenate([g for g, _ in found]).view(np.int64)), *(pa.array(kind[:, k]) for k in range(3))],
                    ["item_id", "place", "gram", "size", "need", "n_words"],
                )

    rows = items.select("item_id", whole_text().alias("text"))
    return written(rows.mapInArrow(run, f"item_id {id_type(items, 'item_id')}, place long, gram long, size long, need long, n_words long").distinct(), "item-grams")


def bit_table(grams: DataFrame):
    """Broadcast flags of two runs of BITS bits of the n-grams: at most 2**BITS numbers reach the driver."""
    spark = grams.sparkSession
    marks = F.explode(F.array(*(F.shiftrightunsigned(F.shiftleft("gram", k * BITS), 64 - BITS).cast("int") for k in (0, 1)))).alias("bit")
    set_bits = grams.select(marks).distinct().toPandas()["bit"].to_numpy()
    flags = np.zeros(1 << BITS, bool)
    flags[set_bits.astype(np.int64)] = True
    return spark.sparkContext.broadcast(np.packbits(flags))


def _marked(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    def bit(g: np.ndarray) -> np.ndarray:
        at = g >> np.uint64(64 - BITS)
        return table[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1

    out = np.flatnonzero(bit(grams))
    return out[bit(grams[out] << np.uint64(BITS)) > 0]


def _dense(places: np.ndarray, least: int, reach: int) -> np.ndarray:
    """Which of the sorted places have ``least`` of them within ``reach`` words."""
    keep = np.zeros(len(places), bool)
    m = len(places) - least + 1
    if m > 0:
        close = places[least - 1 :] - places[:m] <= reach
        for k in range(least):
            keep[k : m + k] |= close
    return keep


def passages(docs: DataFrame, grams: DataFrame, sizes: list[int], least: int, reach: int) -> DataFrame:
    """(doc_id, first, words, grams): stretches of documents around seeds, ``reach`` words on either side; written.

    Seeds of fewer than ``least`` places within ``reach`` words, which no item can do with, make none.
    """
    bits = bit_table(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            row, first, texts, held = [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                found = []
                for size in sizes:
                    g, at = grams_of(words, size)
                    hit = _marked(g, bits.value)
                    found.append((g[hit], at[hit]))
                g, at = np.concatenate([g for g, _ in found]), np.concatenate([at for _, at in found])
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                g, at = g[order], at[order]
                places = np.unique(at)
                keep = np.isin(at, places[_dense(places, least, reach)])
                g, at = g[keep], at[keep]
                if not len(at):
                    continue
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                    lo = max(0, int(at[part[0]]) - reach)
                    row.append(r)
                    first.append(lo)
                    texts.append(b" ".join(words[lo : int(at[part[-1]]) + WIDEST + reach]).decode("utf-8", "replace"))
                    held.append(np.unique(g[part].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(first, pa.int64()), pa.array(texts, pa.string()), pa.array(held, pa.list_(pa.int64()))], ["doc_id", "first", "words", "grams"]
            )

    rows = docs.select("doc_id", whole_text().alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {id_type(docs)}, first long, words string, grams array<long>"), "passages")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best local score, and where it ends in ``a`` and in ``b`` (exclusive)."""
    step = -GAP * np.arange(len(b) + 1)
    before = np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, x in enumerate(a, 1):
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.maximum(before[:-1] + np.where(b == x, MATCH, MISMATCH), before[1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + step) - step
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i, j)
        before = now
    return best


def alignment(item: list, passage: list) -> tuple[int, int, int]:
    """(score, first, last) of the best copy of ``item`` in ``passage``, words last exclusive."""
    names: dict = {}
    a, b = (np.array([names.setdefault(w, len(names)) for w in x], np.int64) for x in (item, passage))
    score, i, j = align(a, b)
    if not score:
        return 0, 0, 0
    _, _, back = align(a[:i][::-1], b[:j][::-1])
    return score, j - back, j


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per (document, test item) whose best local alignment has at least ``threshold`` of the item's own score.

    Columns: doc_id, item_id, score (0 to 1), first_word, last_word (exclusive) of the copy, counted in words of the whole text. Documents
    without a copy have no row. Null or empty texts match nothing; items of fewer than GRAM words are found as exact runs of words
    only (one word of two is no copy). Rows with a null id are left out, since a pair needs both. Of repeated rows the best alignment is returned once. Other columns are ignored.
    Whole texts are read; neither the seeds' frequency nor the number of copies is capped, and every pair that reaches the threshold is found. A row
    per pair and seed is joined, an item that very many documents hold is a skewed key that adaptive execution splits.
    """
    items = items.where("item_id IS NOT NULL")
    docs = docs.where("doc_id IS NOT NULL")
    grams = item_grams(items, threshold)
    most = grams.agg(F.max("n_words").alias("n"), F.min("need").alias("need"), F.collect_set("size").alias("sizes")).first()
    kind, item_kind = id_type(docs), id_type(items, "item_id")
    out = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, last_word long"
    if most["n"] is None:
        return docs.sparkSession.createDataFrame([], out)
    found = passages(docs, grams, sorted(most["sizes"]), most["need"], widest_copy(most["n"], threshold))
    shared = found.select("doc_id", "first", F.explode("grams").alias("gram")).join(grams.select("gram", "item_id", "place", "need"), "gram")
    shared = shared.groupBy("doc_id", "first", "item_id").agg(F.count_distinct("place").alias("n"), F.min("need").alias("need"))
    pairs = shared.where("n >= need").select("doc_id", "first", "item_id")
    rows = pairs.join(found.select("doc_id", "first", "words"), ["doc_id", "first"]).join(items.select("item_id", F.col("text").alias("item")), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, score, lo, hi = [], [], [], []
            for r, (item, passage, first) in enumerate(zip(b.column("item").to_pylist(), b.column("words").to_pylist(), b.column("first").to_pylist(), strict=True)):
                words = words_of(item)
                s, x, y = alignment(words, passage.encode().split())
                s /= MATCH * len(words)
                if s >= (threshold if len(words) >= GRAM else 1.0):
                    keep.append(r)
                    score.append(s)
                    lo.append(first + x)
                    hi.append(first + y)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("item_id").take(at), pa.array(score, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                ["doc_id", "item_id", "score", "first_word", "last_word"],
            )

    scored = rows.select("doc_id", "item_id", "item", "words", "first").mapInArrow(run, out)
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


@query("op9_decontaminate")
def op9(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
