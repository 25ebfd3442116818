"""Token operators against the tokenizers library, on texts that are hard to split, empty, null, long or repeated."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tablewright.llm import pretokens, token_counts, transducer, vocabulary, wavelet

HARD = ["", " ", "\n", "  a", "a  b", "a \n b", "'s it's 'll they'll ''s '  're", "x<|endoftext|>y <|endoftext|>", "naïve café ½ ٣ Ⅷ 漢字 🙂", "\x1c\x85 　z", "a" * 3000, "-=" * 900, "  end  "]


def texts():
    rng = random.Random(3)
    signs = [*"abstvelrmd''  \n\t019.,!-", "é", "ß", "漢", "🙂", "<|endoftext|>", "'ll"]
    return HARD + ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.default_path())


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (1000, None), (1001, "twice"), (1001, "twice"), (None, "no id")]


@pytest.fixture(scope="module")
def expected(library, rows):
    return sorted(((i, t, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def test_counts(documents, rows, expected):
    got = token_counts.token_counts(documents(rows), limit=5).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), len(x), len(x) > 5) for i, t, x in expected)


@pytest.mark.parametrize("both", [transducer.round_trip, lambda df: transducer.decode(transducer.encode(df))])
def test_transducer(documents, rows, expected, both):
    got = transducer.digests(both(documents(rows))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(x), sha(",".join(map(str, x))), sha(t or "")) for i, t, x in expected)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_transducer_emits_early_and_in_blocks():
    t = transducer.transducer()
    raw = ("ab" * 5000).encode()
    read = []

    def blocks():
        for k in range(0, len(raw), 64):
            read.append(k)
            yield raw[k : k + 64]

    out = t.stream(blocks())
    first = next(out)
    assert len(read) < 40  # the first id leaves long before the end
    assert [first, *out] == list(t.stream([raw]))


def test_decoder_replaces_broken_bytes():
    vocab = vocabulary.load()
    ids = np.array([vocab.of_byte[0xF0], vocab.of_byte[0x9F], vocab.of_byte[ord("a")]])
    assert "".join(transducer.decoded(ids)) == b"\xf0\x9fa".decode("utf-8", "replace")


def test_shards(documents, rows, expected):
    shards = wavelet.write_shards(documents(rows), shard_ids=300)
    assert shards.where("n_ids > 300 AND size(doc_ids) > 1").count() == 0
    got = [tuple(r) for r in wavelet.read_documents(shards).collect()]
    want, start = [], 0
    for i, _, ids in expected:
        full = np.array([*ids, 2], "<u4")
        want.append((i, start, len(full), zlib.crc32(full.tobytes())))
        start += len(full)
    assert sorted(got, key=lambda r: r[1]) == want


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 700):
        ids = rng.integers(0, 40, n)
        w = wavelet.WaveletMatrix.open(wavelet.WaveletMatrix.pack(ids))
        assert w.ids().tolist() == ids.tolist() == [w.access(i) for i in range(n)]
        for token in (0, 7, 39, 64, 1000):
            assert w.occurrences(token) == np.flatnonzero(ids == token).tolist()
            assert [w.rank(token, i) for i in range(0, n + 1, 13)] == [int((ids[:i] == token).sum()) for i in range(0, n + 1, 13)]


def test_pretokens_cover_the_text():
    some = texts()
    batch = pretokens.split_batch(some, ["<|endoftext|>"])
    for d, t in enumerate(some):
        assert "".join(batch.words[c] for c in batch.codes[batch.bounds[d] : batch.bounds[d + 1]]) == t


def test_empty_table(documents):
    none = documents([])
    assert token_counts.token_counts(none).count() == 0
    assert transducer.digests(transducer.decode(transducer.encode(none))).count() == 0
    assert wavelet.read_documents(wavelet.write_shards(none)).count() == 0
