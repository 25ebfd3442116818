"""Packing: the subset sum against all subsets, and whole packings against what the contract asks of them."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import packing

RNG = random.Random(5)


def test_fill_is_the_best_subset():
    for _ in range(200):
        sizes = [RNG.randint(1, 30) for _ in range(RNG.randint(0, 9))]
        room = RNG.randint(1, 60)
        counts = Counter(sizes)
        best, taken = packing.fill(sorted((x for x in counts if x <= room), reverse=True), lambda x: counts[x], room)
        assert best == max(sum(s) for r in range(len(sizes) + 1) for s in itertools.combinations(sizes, r) if sum(s) <= room)
        assert best == sum(x * n for x, n in taken.items()) and all(n <= counts[x] for x, n in taken.items())


@pytest.mark.parametrize("pieces", [{}, {1: 1}, {64: 3}, {48: 1000}, {63: 1, 2: 1}, {1: 10**12, 40: 10**11}, {x: x % 5 for x in range(1, 65)}])
def test_plan_pads_nothing(pieces):
    rows = packing.plan(pieces, 64)
    used = Counter()
    for length, first, _, each, _, _, other, made in rows.tolist():
        assert other == 0 or each == 1
        assert made >= pieces.get(other, 0) if other else made == 0
    total = sum(x * n for x, n in pieces.items())
    if total and total < 10**6:
        for x, n in pieces.items():
            for at, _, size, sequence, _ in packing.places(rows, np.full(n, x), np.arange(n)):
                for s, q in zip(size.tolist(), sequence.tolist(), strict=True):
                    used[q] += s
        assert sum(used.values()) == total
        sizes = sorted(used.values())
        assert all(s & s - 1 == 0 for s in sizes) and sum(s < 64 for s in sizes) <= 6
    assert len(rows) < 500


def check(rows, documents, library, window):
    """Every id lies in exactly one piece, sequences have no gaps, and only powers of two go unfilled."""
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in documents:
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert set(got) == set(want)
    for i, each in want.items():
        if len(each) > 1:
            assert sum(r.length for r in got[i]) == sum(map(len, each))
            continue
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            ids = np.array(each[0][at : at + r.length], "<u4")
            assert (r.start, r.length, r.doc_tokens, r.ids_crc32) == (at, len(ids), len(each[0]), zlib.crc32(ids.tobytes()))
            at += r.length
        assert at == len(each[0])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == window or at & at - 1 == 0 and at < window
    assert sorted(sequences) == list(range(len(sequences)))


def test_pack(documents):
    signs = [*"abst  \n\t019.,!-<|>", "İ", "é", "é", "漢", "🙂", "<|endoftext|>", "'ll", "\x1c", " word", ", the"]
    rows = [(i, "".join(RNG.choices(signs, k=RNG.randint(0, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "long word, " * 3000), (303, "twice"), (303, "twice"), (None, "no id"), (304, "x" * 5000)]
    for window in (16, 4096):
        out = packing.pack(documents(rows), window=window)
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        check(out.collect(), rows, packing.encoder(None).library, window)
    assert packing.pack(documents([])).count() == 0
    assert {r.doc_id for r in packing.pack(documents([(1, None)])).collect()} == {1}
    with pytest.raises(ValueError):
        packing.pack(documents(rows), window=100)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 40)
    t = packing.WordEncoder(None)
    texts = ["".join(RNG.choices([*"abΣ  \n\t01.,!<|>", "<|startoftext|>", "'s"], k=300)) for _ in range(100)]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encoded(t, texts)]
    assert got == [t.library.encode(x, add_special_tokens=False).ids for x in texts]


def ids_of(raw):
    return [np.frombuffer(x, "<u4").tolist() for x in raw]


def given_to(encoder):
    """The texts that the encoder's library is given from now on."""
    given, library = [], encoder.library

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    encoder.library = Counted()
    return given


def test_words_of_letters_reach_the_library_once_with_a_blank_between():
    encoder = packing.WordEncoder(None)
    library, given = encoder.library, given_to(encoder)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(150)]
    texts = [" ".join(words), "\n".join(w.upper() for w in words), " ".join(w + "***" for w in words), " ".join(w + '", ' for w in words)]
    assert ids_of(encoder.encode(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, given)) < sum(len(w) + 1 for w in words) + 50


@pytest.mark.parametrize("kept", [600_000, 3])
def test_ids_are_the_librarys_whatever_is_kept(monkeypatch, kept):
    monkeypatch.setattr(packing, "KEPT_WORDS", kept)
    encoder = packing.WordEncoder(None)
    combining = ["̈", "̖", "̊", "̌", "̱", "ְ", "́"]  # the library composes t and U+0308, but not T and U+0308
    signs = [*"aThHJWyÀÉßÞ×÷ÿΣ'.,#*_-`^~<|>=9 \n\t", " ", " the", "<|endoftext|>", "T<|ENDOFTEXT|>", "'S", "　", "漢", "İ", "ǅ", "K", *combining]
    for _ in range(30):
        texts = ["", "T̈ H̖̱", *("".join(RNG.choices(signs, k=RNG.randint(0, 40))) for _ in range(20))]
        assert ids_of(encoder.encode(texts)) == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_file_that_keeps_marks_with_words(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    texts = ["one, two, one. two! (one) é, one", "one,two one two"]
    t = Tokenizer(models.BPE())
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.train_from_iterator(texts * 5, trainers.BpeTrainer(vocab_size=200, special_tokens=["<s>"]))
    t.save(str(tmp_path / "words.json"))
    assert ids_of(packing.WordEncoder(str(tmp_path / "words.json")).encode(texts)) == [t.encode(x, add_special_tokens=False).ids for x in texts]
