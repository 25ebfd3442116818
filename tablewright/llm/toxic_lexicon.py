"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matching, length normalisation, exception phrases.

Folding takes compatibility forms, letter case, accents, look-alike letters of other scripts and digits or signs that
stand for letters to one form, and white space and punctuation to single blanks. Lexicon entries (whole words and word beginnings) and
their weights are learned from labelled documents. In a text every matched word counts with its heaviest entry unless an
exception phrase covers it; the sum, divided by the logarithm of the word count, goes through a fitted logistic curve.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.llm.common import id_type, in_slices, table, whole_text, written
from tablewright.llm.registry import query

#: Look-alikes of Latin letters (Cyrillic, Greek and others), digits and signs used for letters. i, l, 1 and | fold alike.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ո": "n", "ս": "u", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "|": "i", "!": "i",
}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a lexicon word means no harm.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum", "worthless cheque", "sore loser")
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
SUPPORT = 3  # documents of an entry


class _Folding(dict):
    """Character by character, worked out when first met: lower case, without accents, look-alikes replaced."""

    def __missing__(self, c: int):
        out = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        out = "".join(LOOKALIKES.get(x, x) for x in out if x not in INVISIBLE).replace("l", "i")
        self[c] = out
        return out


FOLDING = _Folding()


def folded(text: str) -> list[str]:
    """The words of a text after folding. A sign that may stand for a letter does so only inside a word."""
    return WORD.findall(text.translate(FOLDING))


@dataclass
class Lexicon:
    """weights: ' word ' or ' beginning' -> weight; the curve is 1 / (1 + exp(-(bias + slope * x)))."""

    weights: dict[str, float]
    bias: float = -20.0
    slope: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False)

    def machine(self):
        if self._machine is None:
            m = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                m.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                entry = f" {' '.join(folded(phrase))} "
                m.add_word(entry, (len(entry), None))
            if len(m):
                m.make_automaton()
            self._machine = m
        return self._machine

    def strength(self, text: str) -> float:
        """Weights of the matched words over the logarithm of the word count; 0 for a text without words."""
        words = folded(text)
        m = self.machine()
        if not words or not len(m):
            return 0.0
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, w) in m.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if w is None:
                covered.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        for a, b in covered:
            best = {s: w for s, w in best.items() if not a <= s < b}
        return sum(best.values()) / np.log2(2 + len(words))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.strength(text), -30, 30))))


def uncovered(words: list[str], phrases: list[list[str]]) -> list[str]:
    """The words that no exception phrase covers."""
    covered = set()
    for phrase in phrases:
        at = -1
        for _ in range(words.count(phrase[0])):
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                covered.update(range(at, at + len(phrase)))
    return [w for k, w in enumerate(words) if k not in covered] if covered else words


def _entries(words: list[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) >= 3}
    for k in BEGINNINGS:
        out |= {f" {w[:k]}" for w in words if len(w) > k}
    return out


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents that are not held out, chosen by a hash of doc_id; equal texts once; written."""
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
    some = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return written(docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, entries: int | None = None, chance: float = 1.0) -> Lexicon:
    """Learn a lexicon from at most ``rows`` labelled rows; rows held out (``held_out``) are never looked at.

    For each word and word beginning the toxic and clean documents that have it outside exception phrases are counted. An entry is likelier in toxic
    documents, with a log-likelihood ratio that ``chance`` words of the sample would reach by chance; all of them stay, or the ``entries`` strongest. Its
    weight is the log ratio of its shares, shrunk the more the nearer it is to chance. The curve is fitted to the sample's strengths by Newton steps. Only
    entries and the sample's (strength, label) pairs come to the driver: both are bounded by the parameters.
    """
    sample = labelled(docs, labels, rows)
    phrases = [folded(p) for p in EXCEPTIONS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flush():
            terms = list({*toxic, *clean})
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], ["entry", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return out

        for b in in_slices(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (toxic if label else clean).update(_entries(uncovered(folded(text), phrases)))
                if len(toxic) + len(clean) > 100_000:
                    yield flush()
        yield flush()

    n = {int(r["y"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    t, c = n.get(1, 0), n.get(0, 0)
    if not t or not c:
        return Lexicon({}, bias=float(np.log((t + 0.5) / (c + 0.5))) if t or c else -20.0)
    counted = sample.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    counted = written(counted, "toxic-entries")
    tested = max(1, counted.where(f"a + b >= {SUPPORT}").count())
    a, b = F.col("a"), F.col("b")

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (part(a, (a + b) * t / (t + c)) + part(b, (a + b) * c / (t + c)) + part(t - a, (t + c - a - b) * t / (t + c)) + part(c - b, (t + c - a - b) * c / (t + c)))
    weight = F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (c + 1))
    cut = 2 * float(np.log(tested / chance))
    strong = counted.withColumn("g", ratio).where((weight > 0) & (F.col("g") > cut)).withColumn("w", weight * (1 - cut / F.col("g")))
    kept = (strong if entries is None else strong.orderBy(F.desc("g"), "entry").limit(entries)).collect()
    lexicon = Lexicon({r["entry"]: float(r["w"]) for r in kept})
    pairs = scored(sample, lexicon, "toxic").collect()
    x, y = np.array([r["strength"] for r in pairs]), np.array([float(r["toxic"] > 0) for r in pairs])
    lexicon.bias, lexicon.slope = _curve(x, y)
    return lexicon


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope of a logistic curve; the small ridge keeps them finite when the classes do not overlap."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2), gradient)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def scored(df: DataFrame, lexicon: Lexicon, keep: str) -> DataFrame:
    """(keep, strength, score) of each row's whole text; a null text is empty. If ``keep`` is a struct, its field ``text`` is read, so that texts travel once."""
    inside = isinstance(df.schema[keep].dataType, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = b.column(keep).field("text") if inside else b.column("text")
            x = np.array([lexicon.strength(t or "") for t in texts.to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(x), pa.array(s)], [keep, "strength", "score"])

    rows = df.select(keep) if inside else df.select(keep, whole_text().alias("text"))
    return rows.mapInArrow(run, f"{keep} {id_type(df, keep)}, strength double, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = 12_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold).

    ``labels`` (doc_id, toxic) teach the lexicon, see ``fit``; rows with a null doc_id or label teach nothing, of repeated ones
    the highest label holds. Scores read the text alone. Null and empty texts get the score of a text without matches; without labels
    all scores are near 0. A null doc_id is not held out. Repeated rows are kept, other columns ignored. No shuffle of texts.
    """
    lexicon = fit(docs, labels, rows)
    out = scored(docs, lexicon, "doc_id")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op6_toxic_lexicon")
def op6(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
