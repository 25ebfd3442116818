"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Encoding. For every prefix of a pre-token exactly one token can end it: the token t whose neighbour, the last token of the
prefix before t, stays as it is when both are merged together ("stable pair"). So the last tokens of the prefixes are a
chain that grows byte by byte. A later token begins at most as many bytes back as the longest token that merges can make: this is the
lookahead of the merge list. Once the chains from all positions inside the lookahead meet in one position, everything
before it is fixed: those tokens are emitted and forgotten. Memory does not grow with the text: a long text is split where
a pre-token certainly ends, and a pre-token beyond the lookahead is streamed. All new pre-tokens of a block inside the lookahead
advance byte by byte together.

Decoding. Token bytes feed an incremental UTF-8 machine that keeps at most the three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import vocabulary
from tablewright.llm.common import id_type, in_slices, table, whole_text
from tablewright.llm.pretokens import chunks, gather, split_batch
from tablewright.llm.registry import query

#: What a Python worker keeps between blocks: ids of pre-tokens in two generations of so many, and pairs found stable or not. More is worked out again.
KEPT_WORDS = 80_000
KEPT_PAIRS = 1 << 18
#: Characters of one block of a text, and bytes of pre-tokens that advance together.
BLOCK_CHARS = 400_000
TOGETHER = 1 << 18
NONE = 1 << 40
FACTOR = 0x9E3779B97F4A7C15
#: Where a pre-token ends whatever follows: before a blank or line break after a visible character, and between a letter and a mark.
CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[^\W\d_])(?=[,.;:!?\u3001\u3002\uff0c])")


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Where the keys belong in a table of ``size`` places, a power of two."""
    return ((keys.astype(np.uint64) * np.uint64(FACTOR)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


class Endings:
    """Which tokens end at each byte: a tree of the tokens read from their ends, its steps in one hash table."""

    def __init__(self, tokens: dict[int, bytes]):
        child: dict[int, int] = {}
        token_of = {}
        for i, raw in tokens.items():
            node = 0
            for b in reversed(raw):
                node = child.setdefault(node << 8 | b, len(child) + 1)
            token_of[node] = i
        self.token = np.full(len(child) + 1, -1, np.int32)
        self.token[list(token_of)] = list(token_of.values())
        keys, nodes = np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child))
        self.size = 1 << (2 * len(child)).bit_length()
        self.key, self.node = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32)
        at = slots(keys, self.size)
        while len(keys):  # a key whose place is taken goes one on
            free = self.key[at] == -1
            self.key[at[free]] = keys[free]
            in_ = self.key[at] == keys
            self.node[at[in_]] = nodes[in_]
            keys, nodes, at = keys[~in_], nodes[~in_], (at[~in_] + 1) & self.size - 1

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where the tree has none."""
        key = node << 8 | byte
        at = slots(key, self.size)
        met = self.key[at]
        out = np.where(met == key, self.node[at], -1)
        on = np.flatnonzero((met != key) & (met != -1))
        while len(on):
            at[on] = (at[on] + 1) & self.size - 1
            met = self.key[at[on]]
            hit = met == key[on]
            out[on[hit]] = self.node[at[on[hit]]]
            on = on[~hit & (met != -1)]
        return out

    def find(self, flat: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, sizes, tokens): entries first[p]:first[p + 1] are the tokens that end with byte p, the longest first.

        room[p] is the number of bytes before p that a token may reach back over.
        """
        met, count = [], np.zeros(len(flat), np.int64)
        at, node, back = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        while len(at):
            node = self.step(node, flat[at - back].astype(np.int64))
            token = self.token[node]
            hit = (node >= 0) & (token >= 0)
            where = at[hit]
            met.append((where, count[where], token[hit], back + 1))
            count[where] += 1
            back += 1
            on = (node >= 0) & (room[at] >= back)
            at, node = at[on], node[on]
        first = np.concatenate([[0], np.cumsum(count)])
        sizes, tokens = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        for where, shorter, token, size in met:
            to = first[where + 1] - 1 - shorter
            sizes[to], tokens[to] = size, token
        return first, sizes, tokens


class Transducer:
    def __init__(self, path: str | None = None):
        vocab = vocabulary.load(path)
        self.special = dict(vocab.special)
        made = sorted({i for _, i in vocab.merges.values()} | set(vocab.of_byte))
        top = max(made) + 1
        self.lookahead = max(len(vocab.tokens[i]) for i in made)
        order = np.argsort(np.fromiter(vocab.merges, np.int64, len(vocab.merges)))
        self.keys = np.fromiter(vocab.merges, np.int64, len(vocab.merges))[order]
        self.ranks = np.fromiter((r for r, _ in vocab.merges.values()), np.int64, len(order))[order]
        # the merge that makes each token: its two sides and its rank, the lowest if there are several; bytes have none
        self.left, self.right, self.birth = np.full(top, -1, np.int64), np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        for pair, (rank, i) in sorted(vocab.merges.items(), key=lambda m: -m[1][0]):
            self.left[i], self.right[i], self.birth[i] = pair >> 20, pair & 0xFFFFF, rank
        self.ends = Endings({i: vocab.tokens[i] for i in made})
        self.pair_of, self.pair_holds = np.full(KEPT_PAIRS, -1, np.int64), np.zeros(KEPT_PAIRS, bool)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of the tokens a and b, merged together, are a and b again, for pairs side by side."""
        pair = a << 20 | b
        slot = slots(pair, KEPT_PAIRS)
        out = self.pair_holds[slot]
        new = np.flatnonzero(self.pair_of[slot] != pair)
        if len(new):
            out[new] = self._edges_hold(a[new], b[new])
            self.pair_of[slot[new]], self.pair_holds[slot[new]] = pair[new], out[new]
            # two pairs can meet in one slot: what stands there has to belong to the pair that stands there
            lost = new[self.pair_of[slot[new]] != pair[new]]
            self.pair_of[slot[lost]] = -1
        return out

    def _edges_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges inside a and inside b run in order of rank. The pair breaks if, at some time, the symbol at a's right edge and
        the one at b's left edge have a merge that comes before the next merge of either symbol. Times are walked backwards."""
        holds = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        ends_x, ends_y = np.full(len(a), NONE), np.full(len(a), NONE)
        while len(at):
            key = x << 20 | y
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[k] == key, self.ranks[k], NONE) if len(self.keys) else np.full(len(x), NONE)
            # a merge of equal rank happens leftmost first: inside a before the pair, the pair before inside b
            breaks = (rank < ends_x) & (rank <= ends_y) & (rank < NONE)
            holds[at[breaks]] = False
            born_x, born_y = self.birth[x], self.birth[y]
            on = ~breaks & ((born_x >= 0) | (born_y >= 0))
            at, x, y, ends_x, ends_y, born_x, born_y = (v[on] for v in (at, x, y, ends_x, ends_y, born_x, born_y))
            step_x, step_y = born_x >= born_y, born_y >= born_x
            x, ends_x = np.where(step_x, self.right[x], x), np.where(step_x, born_x, ends_x)
            y, ends_y = np.where(step_y, self.left[y], y), np.where(step_y, born_y, ends_y)
        return holds

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token whose bytes come in blocks; ids leave as soon as they are fixed."""
        look = self.lookahead
        base, tail = 0, b""  # the emitted prefix ends at ``base``; the last bytes read
        last: list[tuple[int, int]] = [(0, -1)]  # for each position after base: the token that ends there, its length
        known: dict[int, bool] = {}
        read = 0
        for block in blocks:
            for at in range(0, len(block), 4 * look):
                step = block[at : at + 4 * look]
                seen = tail[-(look - 1) :] if look > 1 else b""
                both = np.frombuffer(seen + step, np.uint8)
                first, sizes, tokens = (x.tolist() for x in self.ends.find(both, np.arange(len(both))))
                for p in range(len(seen), len(both)):
                    read += 1
                    for size, token in zip(sizes[first[p] : first[p + 1]], tokens[first[p] : first[p + 1]], strict=True):
                        j = read - size - base
                        if j < 0:
                            continue
                        if j > 0 or base > 0:
                            pair = last[j][1] << 20 | token
                            if pair not in known:
                                if len(known) >= KEPT_PAIRS >> 2:
                                    known.clear()
                                known[pair] = bool(self.stable(np.array([last[j][1]]), np.array([token]))[0])
                            if not known[pair]:
                                continue
                        last.append((size, token))
                        break
                tail = (seen + step)[-look:]
                # the chains from all positions that a later token can begin at meet here
                live = set(range(max(0, read - base - look), read - base + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(top - last[top][0])
                    if 0 in live:
                        live = {0}
                meet = live.pop()
                if meet > 0:
                    yield from self._chain(last, meet)
                    last = last[meet:]
                    base += meet
        yield from self._chain(last, len(last) - 1)

    def _chain(self, last: list[tuple[int, int]], end: int) -> list[int]:
        out = []
        while end > 0:
            size, token = last[end]
            out.append(token)
            end -= size
        return out[::-1]

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens inside the lookahead on end, and how many each has; nothing is fixed before a pre-token's end.

        All of them go one byte on at a time: the tokens that end there are tried from the longest down until one is stable.
        """
        words = sorted(enumerate(words), key=lambda w: -len(w[1]))
        place, words = np.array([k for k, _ in words], np.int64), [w for _, w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8)
        first, size_of, token_of = self.ends.find(flat, np.arange(len(flat)) - np.repeat(start, sizes))
        last, span = np.full(len(flat), -1, np.int64), np.zeros(len(flat), np.int64)
        for e in range(1, int(sizes[0]) + 1):
            open_ = start[: np.searchsorted(-sizes, -e, "right")]
            at = open_ + e - 1
            option = first[at]
            while len(at):
                size, token = size_of[option], token_of[option]
                ok = size == e
                inner = np.flatnonzero(~ok)
                ok[inner] = self.stable(last[at[inner] - size[inner]], token[inner])
                last[at[ok]], span[at[ok]] = token[ok], size[ok]
                at, option = at[~ok], option[~ok] + 1
        kept = np.zeros(len(flat), bool)
        at, begin = start + sizes - 1, start
        while len(at):
            kept[at] = True
            at = at - span[at]
            more = at >= begin
            at, begin = at[more], begin[more]
        total = np.concatenate([[0], np.cumsum(kept)])
        lead, count = total[start], total[start + sizes] - total[start]
        back = np.argsort(place)
        return gather(last[kept], np.append(lead, total[-1]), back)[0], count[back]

    def learned(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens and special strings, four bytes each. Those asked for since the last turn of the cache stay in it."""
        out: list[bytes | None] = [self.young.get(w) for w in words]
        new: list[int] = []
        for k, w in enumerate(words):
            if out[k] is None:
                known = self.old.get(w)
                if known is not None:
                    out[k] = self.young[w] = known
                elif w in self.special:
                    out[k] = np.array([self.special[w]], np.int32).tobytes()
                else:
                    new.append(k)
        group, held = [], 0
        for n, k in enumerate(new, 1):
            raw = words[k].encode("utf-8", "surrogatepass")
            if len(raw) > self.lookahead:
                out[k] = np.fromiter(self.stream([raw]), np.int32).tobytes()
            else:
                group.append((k, raw))
                held += len(raw)
            if group and (held >= TOGETHER or n == len(new)):
                ids, count = self.together([r for _, r in group])
                flat, to = ids.astype(np.int32).tobytes(), np.cumsum(count) * 4
                for (i, _), x, y in zip(group, [0, *to[:-1].tolist()], to.tolist(), strict=True):
                    out[i] = self.young[words[i]] = flat[x:y]
                group, held = [], 0
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        return out

    def blocks(self, text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
        """The text in blocks that end where a pre-token ends; a block grows beyond ``limit`` only as far as no such place is found."""
        if len(text) <= limit or any(CUT.search(s) for s in self.special):
            yield text
            return
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + limit) if len(text) - at > limit else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text begins."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for a, b in chunks(texts, BLOCK_CHARS):
            n = np.zeros(b - a, np.int64)
            for block in [texts[a:b]] if b - a > 1 else ([t] for t in self.blocks(texts[a])):
                out, count = self._block(block)
                ids.append(out)
                n += count
            sizes.append(n)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        batch = split_batch(texts, self.special)
        pieces = self.learned(batch.words)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in pieces])]).astype(np.int64)
        out, size = gather(np.frombuffer(b"".join(pieces), np.int32), offsets, batch.codes)
        return out, np.diff(np.concatenate([[0], np.cumsum(size)])[batch.bounds])


@lru_cache(2)
def transducer(path: str | None = None) -> Transducer:
    return Transducer(path)


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)


@lru_cache(2)
def token_bytes(path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids on end and where each id's begin; none for ids that the vocabulary leaves out."""
    tokens = vocabulary.load(path).tokens
    return _table([tokens.get(i, b"") for i in range(max(tokens) + 1)])


@lru_cache(2)
def decimals(path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each id in decimal with a comma behind it, on end, and where each begins."""
    return _table([b"%d," % i for i in range(max(vocabulary.load(path).tokens) + 1)])


def decoded(ids: np.ndarray, path: str | None = None, block: int = 65_536) -> Iterator[str]:
    """The text of a list of ids, in pieces; bytes that are no UTF-8 become U+FFFD. Ids that the vocabulary does not hold say nothing."""
    flat, offsets = token_bytes(path)
    ids = ids[(ids >= 0) & (ids < len(offsets) - 1)]
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), block):
        yield machine.decode(gather(flat, offsets, ids[at : at + block])[0].tobytes())
    yield machine.decode(b"", True)


def _coded(batches: Iterator[pa.RecordBatch], path: str | None, chars: int = 2_000_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids on end, where each row's ids begin) of so many characters at a time, or of one longer text."""
    t = transducer(path)
    for b in in_slices(batches):
        texts = b.column("text").to_pylist()
        for lo, hi in chunks(texts, chars):
            ids, at = t.encode(texts[lo:hi])
            yield b.column("doc_id").slice(lo, hi - lo), ids, at


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; null text as empty text with no ids. Rows, also repeated ones and those with a null doc_id,
    are kept; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ids, at in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([docs, _lists(ids, at)], ["doc_id", "ids"])

    return df.select("doc_id", whole_text(column).alias("text")).mapInArrow(run, f"doc_id {id_type(df)}, ids array<int>")


def round_trip(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """(doc_id, ids, text) of each row: its text encoded, and the ids decoded again, as ``decode(encode(df))`` gives them.

    One Python worker does both for a task, so an executor holds the tables of one worker per core. A null text is an empty text:
    no ids, and the empty text again. Repeated rows and null doc_ids are kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ids, at in _coded(batches, path):
            again = ["".join(decoded(ids[x:y], path)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs, _lists(ids, at), pa.array(again, pa.string())], ["doc_id", "ids", "text"])

    return df.select("doc_id", whole_text(column).alias("text")).mapInArrow(run, f"doc_id {id_type(df)}, ids array<int>, text string")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows (doc_id, ids) with ``text`` decoded from ids; null or empty ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = ["".join(decoded(flat[x:y], path)) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = df.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {id_type(df)}, ids array<int>, text string")


def digests_of(ids: np.ndarray, at: np.ndarray, path: str | None = None, block: int = 65_536) -> Iterator[tuple[str, str]]:
    """(ids_sha256, decoded_sha256) of the lists ids[at[k]:at[k + 1]]; both are hashed block by block, as the machines give them out."""
    flat, offsets = decimals(path)
    spelt, spelt_at, lo, hi = b"", np.zeros(1, np.int64), 0, 0
    for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        named, text = hashlib.sha256(), hashlib.sha256()
        if y > hi and y - x <= block:  # short lists are spelt together
            lo = x
            hi = int(at[max(k + 1, int(np.searchsorted(at, x + block, "right")) - 1)])
            raw, size = gather(flat, offsets, ids[lo:hi])
            spelt, spelt_at = raw.tobytes(), np.concatenate([[0], np.cumsum(size)])
        if y - x <= block:
            named.update(spelt[spelt_at[x - lo] : max(spelt_at[x - lo], spelt_at[y - lo] - 1)])
        else:
            for p in range(x, y, block):
                raw = gather(flat, offsets, ids[p : min(y, p + block)])[0]
                named.update(raw if p + block < y else raw[:-1])
        for piece in decoded(ids[x:y], path, block):
            text.update(piece.encode())
        yield named.hexdigest(), text.hexdigest()


def round_trip_digests(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """``round_trip`` with its lists of ids and texts told by digests: doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by
    commas), decoded_sha256 (of the decoded text in UTF-8). Rows as in ``round_trip``. Only these four columns leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, ids, at in _coded(batches, path, BLOCK_CHARS):
            sums = list(digests_of(ids, at, path))
            columns = [docs, pa.array(np.diff(at)), pa.array([a for a, _ in sums], pa.string()), pa.array([b for _, b in sums], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", whole_text(column).alias("text")).mapInArrow(run, f"doc_id {id_type(df)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(decoded_rows: DataFrame) -> DataFrame:
    """The digests of rows (doc_id, ids, text), as ``round_trip_digests`` gives them; null ids and texts count as empty."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded_rows.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(whole_text().cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op8_bpe_transducer")
def op8(spark, sf_dir):
    return round_trip_digests(table(spark, sf_dir, "documents"))
