"""Token ids in shards that are wavelet matrices: one compressed blob answers access, rank, select and counting.

A shard holds whole documents in ascending doc_id order. Its ids are stored as one bit-plane per bit of the id, from the
highest down; after each plane the ids with bit 0 come before those with bit 1, in unchanged order. The planes are packed
and compressed; counts of ones before each 64-bit word are made when a shard is opened. Shards are rows of a Parquet table
in the shared folder, as Spark commits such files once and any store can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import vocabulary
from tablewright.llm.common import id_type, in_slices, partitions, table, whole_text, written
from tablewright.llm.pretokens import Marked, chunks, gather, named, split_marked
from tablewright.llm.registry import query

MAGIC = b"WVM1"
HEAD = struct.Struct("<4sBQ")  # magic, planes, ids
PLANE = struct.Struct("<QQ")  # zeros, compressed bytes
#: A shard is closed once it holds so many ids; a longer document is a shard of its own.
SHARD_IDS = 2_000_000
KEPT = 1_000_000  # distinct pre-tokens, about 120 bytes each
TOGETHER = 1_000_000  # characters that are split together


class WaveletMatrix:
    """Opened shard. Positions and ids are zero-based; ``rank`` counts before a position."""

    def __init__(self, n: int, zeros: list[int], words: list[np.ndarray]):
        self.n, self.zeros, self.words = n, zeros, words
        self._ones: list[np.ndarray] | None = None

    @staticmethod
    def pack(ids: np.ndarray, planes: int | None = None) -> bytes:
        """The file of ``ids`` (not negative)."""
        top = int(ids.max()) if len(ids) else 0
        planes = max(1, planes or 0, top.bit_length())
        now = ids.astype(np.uint16 if planes <= 16 else np.uint32 if planes <= 32 else np.uint64)
        press = zstandard.ZstdCompressor(level=1)
        out = [HEAD.pack(MAGIC, planes, len(ids))]
        for k in range(planes - 1, -1, -1):
            bit = (now >> now.dtype.type(k) & now.dtype.type(1)).astype(np.uint8).view(bool)
            packed = press.compress(np.packbits(bit, bitorder="little").tobytes())
            ones = np.compress(bit, now)  # faster than a mask
            out += [PLANE.pack(len(now) - len(ones), len(packed)), packed]
            now = np.concatenate([np.compress(~bit, now), ones])
        return b"".join(out)

    @classmethod
    def open(cls, blob: bytes) -> WaveletMatrix:
        magic, planes, n = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at, zeros, words = HEAD.size, [], []
        size = -(-n // 64) * 8
        for _ in range(planes):
            z, length = PLANE.unpack_from(blob, at)
            at += PLANE.size
            raw = zstandard.ZstdDecompressor().decompress(blob[at : at + length], max_output_size=max(1, size))
            at += length
            zeros.append(z)
            words.append(np.frombuffer(raw.ljust(size, b"\0"), np.uint64))
        return cls(n, zeros, words)

    @property
    def ones(self) -> list[np.ndarray]:
        """Ones before each 64-bit word of each plane."""
        if self._ones is None:
            self._ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]) for w in self.words]
        return self._ones

    def _ones_before(self, k: int, i: int) -> int:
        word, rest = divmod(i, 64)
        count = int(self.ones[k][word])
        return count + ((int(self.words[k][word]) & (1 << rest) - 1).bit_count() if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, words in enumerate(self.words):
            bit = int(words[i >> 6]) >> (i & 63) & 1
            ones = self._ones_before(k, i)
            out = out << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the ids equal to ``token`` stand after the last plane: the first one, and that of position ``i``."""
        lo, hi, planes = 0, i, len(self.words)
        for k in range(planes):
            a, b = self._ones_before(k, lo), self._ones_before(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> planes - 1 - k & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before position ``i``."""
        if token < 0 or token >> len(self.words):
            return 0
        lo, hi = self._range(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th 1 or 0 of plane k."""
        ones = self.ones[k]
        before = ones if bit else np.minimum(np.arange(len(ones)) * 64, self.n) - ones
        word = int(np.searchsorted(before, j, "right")) - 1
        rest = j - int(before[word])
        value = int(self.words[k][word])
        value = value if bit else ~value & (1 << 64) - 1
        for _ in range(rest):
            value &= value - 1
        return word * 64 + (value & -value).bit_length() - 1

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence of ``token``."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        i, planes = self._range(token, 0)[0] + j, len(self.words)
        for k in range(planes - 1, -1, -1):
            bit = token >> planes - 1 - k & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the lowest up: ids after a plane go back to their places before it."""
        planes = len(self.words)
        now = np.zeros(self.n, np.uint16 if planes <= 16 else np.uint32 if planes <= 32 else np.uint64)
        for k in range(planes - 1, -1, -1):
            bit = np.unpackbits(self.words[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            before[np.flatnonzero(bit)] = now[self.zeros[k] :] | now.dtype.type(1 << planes - 1 - k)
            now = before
        return now


class LibraryEncoder:
    """Ids as the tokenizers library gives them; each distinct pre-token is handed to it once while it is kept."""

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer

        path = path or vocabulary.default_path()
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        tokens = vocabulary.load(path).tokens
        self.width = np.zeros(max(tokens) + 1, np.int64)  # bytes of each id
        self.width[list(tokens)] = list(map(len, tokens.values()))
        self.forget()

    def forget(self) -> None:
        """Pre-token k has the characters chars[char_at[k]:char_at[k + 1]] and the ids ids[at[k]:at[k + 1]]; ``place`` says which has each sorted mark."""
        self.n = 0
        self.marks, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chars, self.char_at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.ids, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _find(self, m: Marked) -> np.ndarray:
        """Which kept pre-token each distinct one is, -1 for new ones."""
        out = np.full(len(m.marks), -1, np.int64)
        order = np.argsort(m.marks)
        at = np.searchsorted(self.marks, m.marks[order])
        hit = at < len(self.marks)
        hit[hit] = self.marks[at[hit]] == m.marks[order[hit]]
        k, p = order[hit], self.place[at[hit]]
        same = self.char_at[p + 1] - self.char_at[p] == m.span[k]
        k, p = k[same], p[same]
        if len(k):
            mine, theirs = gather(m.cp, m.lead, k, m.span[k])[0], gather(self.chars, self.char_at, p)[0]
            same = np.logical_and.reduceat(mine == theirs, np.cumsum(m.span[k]) - m.span[k])  # another pre-token may have the mark
            out[k[same]] = p[same]
        return out

    def _keep(self, m: Marked, new: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The next places for the pre-tokens ``new`` of ``m``, whose ids stand on end."""
        n, to = self.n, self.n + len(new)
        chars = gather(m.cp, m.lead, new, m.span[new])[0]
        for name, ends, flat, size in (("chars", "char_at", chars, m.span[new]), ("ids", "at", ids, sizes)):
            first = int(getattr(self, ends)[n])
            for grown, room in ((name, first + len(flat)), (ends, to + 1)):
                old = getattr(self, grown)
                if room > len(old):
                    setattr(self, grown, np.concatenate([old, np.zeros(max(room - len(old), len(old)), old.dtype)]))
            getattr(self, name)[first : first + len(flat)] = flat
            getattr(self, ends)[n + 1 : to + 1] = first + np.cumsum(size)
        order = np.argsort(m.marks[new])
        marks = m.marks[new][order]
        at = np.searchsorted(self.marks, marks)
        self.marks, self.place, self.n = np.insert(self.marks, at, marks), np.insert(self.place, at, n + order), to

    def _texts(self, words: list[str], between: str, size: int) -> np.ndarray:
        """Ids of the words with ``between`` after each, so many words to a text."""
        flat: list[int] = []
        for k in range(0, len(words), size):
            flat += self.library.encode_batch_fast([between.join([*words[k : k + size], ""])], add_special_tokens=False)[0].ids
        return np.array(flat, np.int32)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes): the ids of pre-tokens on end, words[order[0]] first, and how many each has.

        Those of a blank and visible characters go to the library on end: a blank between visible characters begins a pre-token, so each is split off
        as it stands, and the bytes of the ids tell where it ends. Others without white space at their end go as lines of one text: a line break is a
        pre-token of its own. The rest go one by one.
        """
        led, lines, rest = [], [], []
        for k, w in enumerate(words):
            if w in self.special or w[-1].isspace():
                rest.append(k)
            elif w[0] == " ":
                led.append(k)
            else:
                lines.append(k)
        order, flat, counts = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

        def found(places: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
            order.extend(places)
            flat.append(ids)
            counts.append(sizes)

        if led:
            own = [words[k] for k in led]
            ids = self._texts(own, "", 1000)
            ends = np.cumsum(self.width[ids])
            want = np.cumsum(np.fromiter([len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in own], np.int64, len(own)))
            to = np.searchsorted(ends, want)
            if len(ids) and ends[-1] == want[-1] and (ends[to] == want).all():
                found(led, ids, np.diff(to, prepend=-1))
            else:
                lines = led + lines
        if lines:
            ids = self._texts([words[k] for k in lines], "\n", 100)
            cut = np.flatnonzero(ids == self.line[0])
            if len(self.line) == 1 and len(cut) == len(lines):
                found(lines, np.delete(ids, cut), np.diff(cut, prepend=-1) - 1)
            else:
                rest = lines + rest
        if rest:
            each = [e.ids for e in self.library.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
            found(rest, np.array([i for ids in each for i in ids], np.int32), np.fromiter(map(len, each), np.int64, len(each)))
        return np.array(order, np.int64), np.concatenate(flat), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, ids of each text."""
        m = split_marked(texts, self.special)
        if m.alike:
            if self.n > KEPT:
                self.forget()
            place = self._find(m)
            new = np.flatnonzero(place < 0)
            if len(new):
                order, ids, sizes = self.learn(m.words(new))
                place[new[order]] = np.arange(self.n, self.n + len(new))
                self._keep(m, new[order], ids, sizes)
            out, size = gather(self.ids, self.at, place[m.codes])
        else:  # marks tell nothing here
            batch = named(m)
            order, ids, sizes = self.learn(batch.words)
            place = np.argsort(order)
            out, size = gather(ids, np.concatenate([[0], np.cumsum(sizes)]), place[batch.codes])
        run = np.concatenate([[0], np.cumsum(size)])
        return out, np.diff(run[m.bounds])


@lru_cache(2)
def library_encoder(path: str | None) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    return LibraryEncoder(path)


SHARDS = "part int, shard int, first long, n_ids long, doc_ids array<{id}>, sizes array<long>, blob binary"


def write_shards(df: DataFrame, path: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode (doc_id, text) and write shards in ascending doc_id order; returns the written table of shards.

    Each document's ids are followed by ``end_id``; a null text is an empty text. Null doc_ids come first; rows of one doc_id
    go by their text. Columns: part and shard (order), first (ids before the shard within its part), n_ids, doc_ids, sizes (ids of
    each document), blob (a WaveletMatrix file). One exchange, by range of doc_id; a task holds one shard.
    """
    spark = df.sparkSession
    kind = id_type(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = library_encoder(path)
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        held, sizes, docs, total = [], [], [], 0

        def close():
            nonlocal held, sizes, docs, total, shard, first
            ids = np.concatenate(held)
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first]), pa.array([total]),
                   pa.array([docs], pa.list_(pa_id)), pa.array([sizes], pa.list_(pa.int64())), pa.array([WaveletMatrix.pack(ids)], pa.binary())]
            shard, first, held, sizes, docs, total = shard + 1, first + total, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "first", "n_ids", "doc_ids", "sizes", "blob"])

        pa_id = pa.int64()
        for b in in_slices(batches):
            pa_id = b.schema.field("doc_id").type
            names, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in chunks(texts, TOGETHER):
                ids, n = encoder.encode(texts[lo:hi])
                at = np.cumsum(n)
                ids, n = np.insert(ids, at, end_id), n + 1
                at = np.concatenate([[0], np.cumsum(n)])
                x = lo
                while x < hi:  # as many documents as fit, one at least
                    room = shard_ids - total
                    y = lo + int(np.searchsorted(at, at[x - lo] + room, "right")) - 1
                    y = min(hi, max(y, x + (not held)))
                    if y > x:
                        held.append(ids[at[x - lo] : at[y - lo]])
                        sizes += n[x - lo : y - lo].tolist()
                        docs += names[x:y]
                        total += int(at[y - lo] - at[x - lo])
                    x = y
                    if x < hi:
                        yield close()
        if held:
            yield close()

    rows = df.select("doc_id", whole_text().alias("text"))
    placed = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(placed.mapInArrow(run, SHARDS.format(id=kind)), "token-shards")


def part_starts(shards: DataFrame) -> DataFrame:
    """(part, before): ids of all earlier parts. One row per part, of which there are as many as shuffle partitions."""
    spark = shards.sparkSession
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).sort("part").collect()
    out, before = [], 0
    for r in totals:
        out.append((r["part"], before))
        before += r["n"]
    return spark.createDataFrame(out, "part int, before long")


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document, read from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. An empty table has no rows.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                sizes = b.column("sizes")[r].values.to_numpy()
                ids = WaveletMatrix.open(b.column("blob")[r].as_buffer().to_pybytes()).ids().astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                start = at[:-1] + (b.column("before")[r].as_py() + b.column("first")[r].as_py())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[r].values, pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    placed = shards.join(F.broadcast(part_starts(shards)), "part")  # one row per part
    return placed.select("before", "first", "doc_ids", "sizes", "blob").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


@query("op7_token_shards")
def op7(spark, sf_dir):
    return read_documents(write_shards(table(spark, sf_dir, "documents")))
