"""Split batches of texts into the pre-tokens of a byte-level BPE vocabulary, all characters of a batch at once.

A pre-token is a contraction ('s 't 're 've 'm 'll 'd), a run of letters, of numbers or of other characters with at most
one blank in front, or white space; of white space before a word the last character stands apart. Pre-tokens repeat, so a
batch is returned as its distinct pre-tokens and an index into them: the merge work is done once for each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
#: The characters of Unicode's White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
FACTOR = 0x9E3779B97F4A7C15
#: Characters that are split together; a longer text is a batch of its own.
BATCH_CHARS = 500_000


@lru_cache(1)
def classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """FACTOR**i and its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return [p[:n] for p in _POWERS]


@dataclass
class Batch:
    """codes[bounds[d]:bounds[d + 1]] are the pre-tokens of text d as positions in ``words``."""

    words: list[str]
    codes: np.ndarray
    bounds: np.ndarray


def starts_of(cp: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Flags of the characters that begin a pre-token; ``cut`` flags where a text or special string begins or has ended."""
    n = len(cp)
    new = cut.copy()
    new[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    what = kind[first]
    joined = np.append(~cut[first[1:]], False)  # the next run belongs to the same text
    start = new
    before = (what == SPACE) & joined
    last = end[before] - 1
    blank = cp[last] == 0x20
    start[last] = True
    start[end[before][blank]] = False
    led = np.zeros(len(first), bool)  # runs that a blank in front belongs to
    led[np.flatnonzero(before)[blank] + 1] = True
    quote = (what == OTHER) & (end - first == 1) & (cp[first] == 0x27) & joined & ~led
    at = np.flatnonzero(quote)
    at = at[what[at + 1] == LETTER]
    if len(at):
        p, size = first[at] + 1, end[at + 1] - first[at + 1]
        a, b = cp[p], cp[np.minimum(p + 1, n - 1)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (size >= 2) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        taken = np.where(one, 1, np.where(two, 2, 0))
        start[p[taken > 0]] = False
        rest = (taken > 0) & (size > taken)
        start[(p + taken)[rest]] = True
    return start


@dataclass
class Marked:
    """The pre-tokens of joined texts by a 64-bit mark each: distinct pre-token k is text[lead[k]:lead[k] + span[k]], ``cp`` are its characters.

    ``alike`` tells whether equal marks are equal pre-tokens here; ``start`` and ``end`` are the places of all pre-tokens, ``codes`` and ``bounds``
    as in ``Batch``.
    """

    text: str
    cp: np.ndarray
    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    marks: np.ndarray
    lead: np.ndarray
    span: np.ndarray
    alike: bool

    def words(self, at: np.ndarray | slice = slice(None)) -> list[str]:
        return [self.text[a : a + k] for a, k in zip(self.lead[at].tolist(), self.span[at].tolist(), strict=True)]


def split_batch(texts: list[str], special: Iterable[str] = ()) -> Batch:
    return named(split_marked(texts, special))


def named(m: Marked) -> Batch:
    if m.alike:
        return Batch(m.words(), m.codes, m.bounds)
    words = [m.text[a:b] for a, b in zip(m.start, m.end, strict=True)]  # two pre-tokens share a mark
    codes, distinct = pd.factorize(np.array(words, object))
    return Batch(list(distinct), codes, m.bounds)


def split_marked(texts: list[str], special: Iterable[str] = ()) -> Marked:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    text = "".join(texts)
    n = len(text)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Marked("", none.astype(np.uint32), none, none, none, np.zeros(len(texts) + 1, np.int64), none.astype(np.uint64), none, none, True)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[cp]
    cut = np.zeros(n + 1, bool)
    cut[text_at] = True
    for s in special:
        for d, t in enumerate(texts):
            at = t.find(s)
            while at >= 0:
                a = int(text_at[d]) + at
                kind[a : a + len(s)] = SPECIAL
                cut[a] = cut[a + len(s)] = True
                at = t.find(s, at + len(s))
    start = np.flatnonzero(starts_of(cp, kind, cut[:n]))
    end = np.append(start[1:], n)
    up, down = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    size = end - start
    mark = (total[end] - total[start]) * down[start] ^ (size.astype(np.uint64) << np.uint64(48))
    codes, uniques = pd.factorize(mark)
    lead = np.zeros(len(uniques), np.int64)
    lead[codes[::-1]] = start[::-1]
    span = np.zeros(len(uniques), np.int64)
    span[codes] = size
    alike = not ((span[codes] != size).any() or (cp[np.arange(n) + np.repeat(lead[codes] - start, size)] != cp).any())
    return Marked(text, cp, start, end, codes, np.searchsorted(start, text_at), uniques, lead, span, alike)


def chunks(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with at most ``limit`` characters, or a single longer one."""
    a = total = 0
    for i, t in enumerate(texts):
        if i > a and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[offsets[c]:offsets[c + 1]] for all c in ``codes`` on end, and the sizes of the pieces; with ``size`` they are so long."""
    size = offsets[codes + 1] - offsets[codes] if size is None else size
    to = np.cumsum(size)
    return flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(offsets[codes] - (to - size), size)], size
