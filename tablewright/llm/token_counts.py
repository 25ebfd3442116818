"""Token counts by heap-and-linked-list byte-pair merging; no ids are made for a text."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import vocabulary
from tablewright.llm.common import id_type, in_slices, table, whole_text
from tablewright.llm.pretokens import chunks, split_batch
from tablewright.llm.registry import query

#: Counts of pre-tokens that a Python worker keeps between batches; more are counted again, never guessed.
KEPT = 800_000
_COUNTS: dict[str, dict[str, int]] = {}


def merged_count(piece: bytes, vocab: vocabulary.Vocabulary) -> int:
    """Tokens of one pre-token: symbols at first minus merges.

    The heap holds (rank, position) of the adjacent pairs; a pair that a merge has changed meanwhile is passed over.
    """
    merges = vocab.merges
    symbol = [vocab.of_byte[b] for b in piece]
    n = left = len(symbol)
    if n < 2:
        return n
    heap = []
    for i in range(n - 1):
        found = merges.get(symbol[i] << 20 | symbol[i + 1])
        if found:
            heap.append(found[0] << 32 | i)
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if symbol[i] < 0 or j >= n:
            continue
        found = merges.get(symbol[i] << 20 | symbol[j])
        if not found or found[0] != top >> 32:
            continue
        symbol[i], symbol[j] = found[1], -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            pair = merges.get(symbol[i] << 20 | symbol[k])
            if pair:
                heappush(heap, pair[0] << 32 | i)
        h = before[i]
        if h >= 0:
            pair = merges.get(symbol[h] << 20 | symbol[i])
            if pair:
                heappush(heap, pair[0] << 32 | h)
    return left


def counts_of(texts: list[str], path: str | None = None) -> np.ndarray:
    """Tokens of each text."""
    vocab = vocabulary.load(path)
    known = _COUNTS.setdefault(path or "", {})
    out = np.zeros(len(texts), np.int64)
    for a, b in chunks(texts):
        batch = split_batch(texts[a:b], vocab.special)
        if len(known) > KEPT:
            known.clear()
        each = np.zeros(len(batch.words), np.int64)
        for i, w in enumerate(batch.words):
            c = known.get(w)
            if c is None:
                c = known[w] = 1 if w in vocab.special else merged_count(w.encode("utf-8", "surrogatepass"), vocab)
            each[i] = c
        run = np.concatenate([[0], np.cumsum(each[batch.codes])])
        out[a:b] = np.diff(run[batch.bounds])
    return out


def token_counts(df: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are kept; other columns are ignored.
    ``path`` names a byte-level BPE file; None takes the one installed where the task runs. Memory: one batch and the kept
    counts. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            n = counts_of(b.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select("doc_id", whole_text().alias("text"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"doc_id {id_type(df)}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
