"""Stages of the pipeline on nulls, empty and long texts, repeated rows, other columns and empty tables, and a whole run against plain rules."""

import hashlib

import pytest

import corpus_pipeline as P
from tablewright.llm import decontaminate, signature_join, transducer, vocabulary

ITEM = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), {"a": 1}) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>")
        frame.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "forty two")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([(i, 1, k % 2) for k, (i, _) in enumerate(rows[:4])], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return make


ODD = [(1, None), (2, ""), (3, "plain words without harm " * 3), (3, "plain words without harm " * 3), (4, "word " * 30_000), (None, f"so {ITEM} it was"), (None, "kept though it has no number"), (5, f"again {ITEM}"),
       (6, "the answer is forty two as ever"), (7, "forty apples and two pears")]


@pytest.mark.parametrize("name, stage", P.STAGES)
@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, folder, name, stage, rows):
    path = folder(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = stage(spark, docs, path)
    if name != "bpe":
        assert out.columns == docs.columns
    got = out.collect()
    if name in ("secrets", "bpe"):
        assert len(got) == len(rows)


def test_leaks_go_with_and_without_an_id(spark, folder):
    path = folder(ODD)
    out = P.decontamination(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in out) == sorted((str(i), (t or "")[:20]) for i, t in ODD if i not in (5, 6) and ITEM not in (t or ""))


def test_run_against_plain_rules(spark, folder):
    library = __import__("tokenizers").Tokenizer.from_file(vocabulary.default_path())
    rows = [(k, f"document {k} tells of " + " ".join(f"w{k}x{j}" for j in range(30)) + ("." if k % 3 else " " + ITEM)) for k in range(10, 30)]
    rows += [(50, rows[1][1]), (51, rows[2][1] + " tail")]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, folder(rows)).collect()}
    want = {}
    for i, t in rows:
        if ITEM not in t and i < 50:
            ids = library.encode(t, add_special_tokens=False).ids
            want[i] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    assert got == want


def test_short_items_are_exact_runs(spark):
    docs = spark.createDataFrame([(1, "answer forty two end"), (2, "forty and two"), (3, "Forty-two!"), (4, "two forty")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "forty two"), (2, "answer")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 1, 1.0), (1, 2, 1.0), (3, 1, 1.0)]


def test_a_long_text_keeps_memory_small():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    t = transducer.transducer()
    text = " ".join(f"word{k % 5000} and" for k in range(900_000))
    t.encode([text[:100_000]])
    before, most = resident(), 0
    split = t._block

    def watched(texts):
        nonlocal most
        out = split(texts)
        most = max(most, resident())
        return out

    t._block = watched
    try:
        ids, _ = t.encode([text])
    finally:
        del t._block
    assert len(text) > 10_000_000 and most - before < 100_000_000
    assert "".join(transducer.decoded(ids)) == text


def test_files_with_other_settings_are_refused(tmp_path):
    import json

    with open(vocabulary.default_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError, match="normalizer"):
        vocabulary.load(str(path))


def test_near_duplicates_of_one_id_keep_one_row_of_a_text(spark, folder):
    path = folder(ODD)
    out = P.near_duplicates(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert out.where("doc_id = 3").count() == 1
    assert signature_join.near_duplicates(spark.read.parquet(f"{path}/documents.parquet").limit(0)).count() == 0
