"""What workers hand to libraries, hold and send: results are compared elsewhere, these tests keep the work from growing again."""

import sys

import numpy as np
import pyarrow as pa
import pyspark
import pytest

import corpus_pipeline
from tablewright.llm import divergence, pretokens, toxic_lexicon, wavelet

TEXTS = ["One two  three\n\nfour it's 12 we'll", "", " ", "\tone two one two\r\n", "naïve 漢字 a b　c", "<|endoftext|> x <|endoftext|>", "x" * 300, " 'tis é é"]


class Taken:
    """Stands for a table: keeps the function of its mapInArrow and the columns asked for."""

    def __init__(self, schema=None):
        self.schema, self.asked = schema, []

    def select(self, *columns):
        self.asked.append(columns)
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def wanted(encoder, texts):
    return [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def as_lists(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_blank_led_words_reach_the_library_without_line_breaks():
    encoder = wavelet.LibraryEncoder(None)
    given, library = [], encoder.library

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    encoder.library = Counted()
    words = [f" w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    order, ids, sizes = encoder.learn(words)
    assert sum(map(len, given)) == sum(map(len, words))
    assert as_lists(ids, sizes) == [library.encode(words[k], add_special_tokens=False).ids for k in order]


@pytest.mark.parametrize("kept", [1_000_000, 3])
def test_ids_are_the_librarys_whatever_is_kept(monkeypatch, kept):
    monkeypatch.setattr(wavelet, "KEPT", kept)
    encoder = wavelet.LibraryEncoder(None)
    for texts in (TEXTS, TEXTS[::-1], [t + " more" for t in TEXTS], TEXTS):
        assert as_lists(*encoder.encode(texts)) == wanted(encoder, texts)


@pytest.mark.parametrize("inverse", [True, False])
def test_pre_tokens_that_share_a_mark_stay_apart(monkeypatch, inverse):
    """Marks of the size alone: pre-tokens of one text clash, and with the kept ones of others."""

    def same(n):
        return [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]

    monkeypatch.setattr(pretokens, "powers", same)
    encoder = wavelet.LibraryEncoder(None)
    for texts in (TEXTS, ["abc"], ["xyz"], ["abc"], ["abc", "abc"], ["one two"]):
        texts = texts[::-1] if inverse else texts
        assert as_lists(*encoder.encode(texts)) == wanted(encoder, texts)


def test_terms_of_a_task_are_no_python_objects(spark, monkeypatch):
    class Context:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    table, n = Taken(), 20_000
    divergence.mentions(table, 3)
    text = " ".join(chr(97 + i % 26) * 2 + chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26) + chr(97 + i // 17576) for i in range(n)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a", "b"]), pa.array([text, b"aaaaa aaaaa"], pa.binary())], ["lang", "source", "text"])
    before = sys.getallocatedblocks()
    rows = table.run(iter([batch]))
    out = next(rows)
    assert sys.getallocatedblocks() - before < n / 2
    found = {(r["lang"], r["term"]): r for r in out.to_pylist()}
    assert len(found) == n + 1 and found["de", b"aaaaa"]["sources"] == [{"source": "b", "n": 2}] and found["en", b"aaaaa"]["docs"] == [0]


def test_texts_reach_the_toxicity_stage_once(spark):
    docs = spark.createDataFrame([(1, "Trash"), (2, None), (3, "")], "doc_id long, text string").selectExpr("struct(*) AS row")
    table = Taken(docs.schema)
    toxic_lexicon.scored(table, toxic_lexicon.Lexicon({}), "row")
    assert table.asked == [("row",)]
    lexicon = toxic_lexicon.Lexicon({" trash ": 3.0}, -1.0, 2.0)
    got = {r["row"]["doc_id"]: r["score"] for r in toxic_lexicon.scored(docs, lexicon, "row").collect()}
    assert got == {1: lexicon.score("Trash"), 2: lexicon.score(""), 3: lexicon.score("")}


def test_only_digests_leave_the_worker_of_bpe(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert "ids#" not in corpus_pipeline.bpe(spark, docs, "")._jdf.queryExecution().toString()
