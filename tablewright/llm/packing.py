"""Packing of documents into sequences by minimum bin slack.

A document's ids are cut into whole windows and one rest. How many pieces there are of each length, at most as many numbers as a
window has tokens, is all that the packing is worked out from, whatever the size of the corpus: the longest length left opens a
window, a subset-sum over a bitset finds the multiset of the other lengths that comes closest to filling it, and the counts traced
back from the bitset are laid down as often as the pieces suffice. Where even the best multiset leaves room, one longer piece is
cut to fill it and its other part returns to the lengths. What is left at the end, less than a window, fills windows of powers of
two. So no sequence is padded. Executors then find each piece's place from its length and its number among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.llm.common import id_type, in_slices, table, whole_text, written
from tablewright.llm.pretokens import gather
from tablewright.llm.registry import query

WINDOW = 4096
#: What a Python worker keeps between slices: ids of words, in two generations of so many. More is asked of the library again.
KEPT_WORDS = 600_000
#: Between a Latin letter (A-Z, a-z, U+00C0 to U+00FF) and one of these no pre-token reaches across, if the file splits there; normalising joins none of them to a letter.
MARKS = "!\"#$%&'()*+,-./:;?@[\\]^_`{|}~"
#: Characters of a text that are looked at together; a text is cut only at a blank or a line break.
BLOCK_CHARS = 1_500_000


def fill(lengths: Iterable[int], counts: Callable[[int], int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of a multiset with at most counts(x) pieces of each length x, and one that reaches it.

    ``lengths``, none above ``room``, are tried from the first on; a bitset holds the sums that the lengths so far can reach, and the bitsets before each
    step are kept so that the counts can be traced back from the sum. Ends as soon as the room is filled whole.
    """
    sums, mask, steps = 1, (1 << room + 1) - 1, []
    for x in lengths:
        left, k = min(counts(x), room // x), 1
        while left:  # 1, 2, 4, ... pieces and the rest make every number of pieces
            k = min(k, left)
            steps.append((x, k, sums))
            sums |= sums << k * x & mask
            left, k = left - k, 2 * k
        if sums >> room:
            break
    best = at = sums.bit_length() - 1
    taken: Counter[int] = Counter()
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            taken[x] += k
            at -= k * x
    return best, dict(taken)


def plan(pieces: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Where pieces go, from how many there are of each length up to ``window``.

    Rows (length, first number, sequence, each, offset, size, other length, other first): the pieces of ``length`` numbered from
    ``first number`` go to the sequences from ``sequence`` on, ``each`` of them to one, on end from ``offset``. Of a piece that is cut only
    ``size`` ids go there; its other part is a piece of ``other length`` numbered from ``other first`` on. Otherwise ``other length`` is 0.
    """
    left = Counter({x: n for x, n in pieces.items() if n > 0})
    used, made = Counter(), Counter(left)  # numbers given out, numbers that exist
    total, sequence, rows = sum(x * n for x, n in left.items()), 0, []
    lengths = sorted(left)
    while total:
        size = window if total >= window else 1 << total.bit_length() - 1
        at = bisect_right(lengths, size)
        need: Counter[int] = Counter(lengths[at - 1 : at])
        room = size - sum(need)
        best, taken = fill(reversed(lengths[: bisect_right(lengths, room)]), lambda x: left[x] - need[x], room)
        need.update(taken)
        slack = room - best
        cut = 0
        if slack:  # whatever is left is longer than the slack, or it would be in the multiset
            cut = next(x for x in reversed(lengths) if left[x] > need[x])
            need[cut] += 1
        times = min(left[x] // n for x, n in need.items())
        offset = 0
        for x, n in need.items():
            n -= x == cut
            if n:
                rows.append((x, used[x], sequence, n, offset, x, 0, 0))
                used[x] += n * times
                offset += n * x
        if cut:
            other = cut - slack
            rows.append((cut, used[cut], sequence, 1, offset, slack, other, made[other]))
            used[cut] += times
            made[other] += times
            if not left[other]:
                insort(lengths, other)
            left[other] += times
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del lengths[bisect_left(lengths, x)]
        sequence += times
        total -= size * times
    return np.array(sorted(rows), np.int64).reshape(-1, 8)


def places(rows: np.ndarray, length: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(piece, start in it, size, sequence, offset) of all parts of the pieces, in turns: a piece's next part comes in the next turn."""
    keys = rows[:, 0] << 48 | rows[:, 1]
    at, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    while len(at):
        r = rows[np.searchsorted(keys, length << 48 | number, "right") - 1]
        nth = number - r[:, 1]
        each, cut = r[:, 3], r[:, 6] > 0
        yield at, start, r[:, 5], r[:, 2] + nth // each, r[:, 4] + nth % each * r[:, 0]
        at, start, length, number = at[cut], start[cut] + r[cut, 5], r[cut, 6], r[cut, 7] + nth[cut]


class WordEncoder:
    """Ids as the tokenizers library gives them, for a file whose pre-tokens never hold white space; a text is given to it by its
    words between blanks and line breaks, each distinct one once while it is kept. Texts of a block are cut by the bytes of all, and only its
    distinct words become Python objects."""

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path or default_path())
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        plain = [i for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        if len(plain) < len(added) or not added or any(set(s) & {" ", "\n"} for s in self.special):
            raise ValueError("added tokens that strip, match words or hold blanks would reach over words")
        if self.ids(["a b\nc"]) != [i for w in "abc" for i in self.ids([w])]:
            raise ValueError("white space has ids of its own in this file; words cannot be encoded apart")
        self.mark = added[plain[0]].content, plain[0]
        self.risky = re.compile("[" + re.escape("".join({s[0] + s[-1] for s in self.special})) + "]")  # a special string may begin or end there
        self.opening = {s[0] for s in self.special}
        self.marks = np.zeros(256, bool)
        self.marks[[ord(m) for m in MARKS if self.library.pre_tokenizer and self._splits(m) and not any(m in s for s in self.special)]] = True
        vocab = self.library.get_vocab(with_added_tokens=False)
        end = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max([*vocab.values(), *added]) + 1, bool)  # ids that end a pre-token; none if not every pre-token has one
        if end and all(c + end in vocab for c in ByteLevel.alphabet()):
            self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _splits(self, mark: str) -> bool:
        return any(end == 1 for _, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(f"a{mark}a"))

    def ids(self, texts: list[str]) -> list[int]:
        return [i for e in self.library.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words. Words of letters go to the library together, a blank between them, if the ids tell where each ends; others that no special
        string can begin or end in go with a special string between them, the rest one by one."""
        text = [w.decode("utf-8", "surrogatepass") for w in words]
        out = [b""] * len(words)
        letters, joined = [], []
        for k, w in enumerate(text):
            if self.risky.search(w):
                out[k] = np.array(self.ids([w]), "<u4").tobytes()
            else:
                (letters if w.isalpha() else joined).append(k)

        def found(some: list[int], ids: np.ndarray, start: list[int], end: list[int]) -> None:
            raw = ids.tobytes()
            for k, x, y in zip(some, start, end, strict=True):
                out[k] = raw[4 * x : 4 * y]

        for a in range(0, len(letters), 200):
            some = letters[a : a + 200]
            ids = np.array(self.ids([" ".join([text[k] for k in some])]), "<u4")
            end = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(end) == len(some) and end[-1] == len(ids):  # each is one pre-token
                found(some, ids, [0, *end[:-1]], end)
            else:
                joined += some
        between, mark = self.mark
        for a in range(0, len(joined), 200):
            some = joined[a : a + 200]
            ids = np.array(self.ids([between.join([text[k] for k in some])]), "<u4")
            cut = np.flatnonzero(ids == mark)
            found(some, ids, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])
        return out

    def words(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct words, codes, bounds): codes[bounds[d]:bounds[d + 1]] are the words of text d, whose ids stand on end: its parts between blanks and line
        breaks, and between a letter and a mark behind it.

        Latin letters are made small where the library does the same: not in front of a combining sign, as it composes both before that, and not
        in a text with a special string, as it looks for those before that.
        """
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = np.cumsum([0, *[len(r) + 1 for r in raw]])
        a = np.frombuffer(bytearray(b"\n".join([*raw, b""])), np.uint8)
        del raw
        second = np.zeros(len(a), bool)  # second byte of U+00C0 to U+00FF
        second[1:] = a[:-1] == 0xC3
        large = (a - np.uint8(65) < 26) | second & (a <= 0x9E) & (a != 0x97)
        large[:-1] &= (a[1:] < 0x80) | (a[1:] == 0xC3)
        for d, t in enumerate(texts):
            if any(c in t for c in self.opening):
                large[at[d] : at[d + 1]] = False
        a += large.view(np.uint8) << np.uint8(5)
        letter = ((a | np.uint8(32)) - np.uint8(97) < 26) | second & ((a | np.uint8(32)) != 0xB7)  # U+00D7 and U+00F7 are signs
        blank = (a == 32) | (a == 10)
        start = self.marks[a]
        start[1:] &= letter[:-1]
        start[1:] |= blank[:-1]
        start[:1] = True
        seen = ~blank
        bounds = np.searchsorted(np.flatnonzero(start & seen), at)
        chars = np.compress(seen, a)
        first = np.flatnonzero(np.compress(seen, start))
        ends = pa.py_buffer(np.append(first, len(chars)).astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(chars)]).dictionary_encode()
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        words, codes, bounds = self.words(texts)
        each = list(map(self.young.get, words))
        new = [k for k, x in enumerate(each) if x is None]
        again = {words[k]: self.old[words[k]] for k in new if words[k] in self.old}
        fresh = [words[k] for k in new if words[k] not in again]
        again.update(zip(fresh, self.learn(fresh), strict=True))
        self.young |= again
        for k in new:
            each[k] = again[words[k]]
        ends = np.cumsum([0, *map(len, each)]) // 4
        ids, size = gather(np.frombuffer(b"".join(each), "<u4"), ends, codes)
        at = np.append(0, np.cumsum(size))[bounds].tolist()
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        return [ids[x:y].tobytes() for x, y in zip(at, at[1:])]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def encoder(path: str | None) -> WordEncoder:
    return WordEncoder(path)


def blocks(text: str) -> Iterator[str]:
    """A text in parts that end before a blank or a line break."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK_CHARS:
            ends = [p for p in (text.find(" ", at + BLOCK_CHARS), text.find("\n", at + BLOCK_CHARS)) if p > 0]
            end = min(ends, default=end)
        yield text[at:end]
        at = end


def encoded(t: WordEncoder, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text; short texts go together, a long one in blocks."""
    held: list[str] = []
    size = 0
    for x in [*texts, None]:
        if held and (x is None or size + len(x) > BLOCK_CHARS):
            yield from t.encode(held)
            held, size = [], 0
        if x is None:
            return
        if len(x) > BLOCK_CHARS:
            yield b"".join(t.encode([b])[0] for b in blocks(x))
        else:
            held.append(x)
            size += len(x)


def pieces(df: DataFrame, path: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Whole windows and the rest of each document's ids: doc_id, start, length, ids_crc32, doc_tokens, part and number (of the piece among
    those of its length in its task), ids (of the rest, four bytes each, for cuts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part, numbers, end = encoder(path), TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for b in in_slices(batches):
            row, start, length, crc, tokens, number, rest = ([] for _ in range(7))
            for k, raw in enumerate(encoded(t, b.column("text").to_pylist())):
                raw += end
                view, n = memoryview(raw), len(raw) // 4
                for x in range(0, n, window):
                    size = min(window, n - x)
                    row.append(k)
                    start.append(x)
                    length.append(size)
                    crc.append(zlib.crc32(view[4 * x : 4 * (x + size)]))
                    tokens.append(n)
                    number.append(numbers[size])
                    rest.append(bytes(view[4 * x : 4 * (x + size)]) if size < window else None)
                    numbers[size] += 1
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                       pa.array(tokens, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(number, pa.int64()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "ids"])

    rows = df.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(df)}, start long, length long, ids_crc32 long, doc_tokens long, part int, number long, ids binary")


def pack(df: DataFrame, path: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Sequences of at most ``window`` tokens from (doc_id, text): one row per piece with doc_id, start (ids of its document before it), length,
    ids_crc32 (unsigned, of its ids as little-endian unsigned 32-bit integers), doc_tokens, sequence_id (from 0 on), offset.

    Each document's ids, ``end_id`` behind them, lie in exactly one piece each. Every sequence holds exactly ``window`` ids, but for at most
    log2(window) last ones whose sizes are smaller powers of two; offsets of a sequence have no gaps. A null text is an empty one, a piece
    of ``end_id`` alone. Null doc_ids, repeated doc_ids and repeated rows are documents of their own; other columns are
    ignored; an empty table gives no rows. ``window`` is a power of two and ``path`` a file for the tokenizers library whose pre-tokens hold
    no white space (ValueError otherwise).

    No text is shuffled. Numbers per length come from counts per task, so that no length, however frequent, meets in one task; the driver holds
    one count per length, and the plan it broadcasts has a few rows per length.
    """
    if window < 1 or window & window - 1:
        raise ValueError("the window has to be a power of two")
    spark, kind = df.sparkSession, id_type(df)
    cut = written(pieces(df, path, end_id, window), "pieces")
    counts = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("length", "part", before.alias("before")), "piece-offsets")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    rows = plan(totals, window)
    shared = spark.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b.column("number").to_numpy() + b.column("before").to_numpy()
            for at, start, size, sequence, offset in places(shared.value, b.column("length").to_numpy(), number):
                got = b.take(pa.array(at))
                columns = [got.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *map(pa.array, (start, size, sequence, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "skip", "size", "sequence_id", "offset"]
                )

    narrow = cut.drop("ids").join(offsets, ["length", "part"])
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, number long, skip long, size long, sequence_id long, offset long"
    placed = written(narrow.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "before").mapInArrow(place, fields), "placed")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            crc = [
                zlib.crc32(memoryview(x)[4 * s : 4 * (s + n)])
                for x, s, n in zip(b.column("ids").to_pylist(), b.column("skip").to_pylist(), b.column("size").to_pylist(), strict=True)
            ]
            keep = [i for i, f in enumerate(b.schema) if f.name not in ("ids", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(crc, pa.int64())], [*[b.schema[i].name for i in keep], "ids_crc32"])

    last = ["doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("size").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parted = placed.where("size < length").drop("ids_crc32").join(cut.where("ids IS NOT NULL").select("length", "part", "number", "ids"), ["length", "part", "number"])
    some = parted.select("doc_id", "start", "skip", "size", "doc_tokens", "sequence_id", "offset", "ids")
    named = some.mapInArrow(sums, f"doc_id {kind}, start long, skip long, size long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    return placed.where("size = length").select(*last).unionByName(named.select(*last))


@query("op13_bin_slack")
def op13(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
