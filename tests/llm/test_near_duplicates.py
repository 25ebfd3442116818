"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import embedding_caps, signature_join
from tablewright.llm.components import components


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(300)]
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    nodes = {n for x in links if x[0] != x[1] for n in x}
    assert {r.node: r.component for r in components(df).collect()} == groups(nodes, links)
    assert components(df.limit(0)).count() == 0


def shingle_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def near(rows, size, percent=80):
    sets = shingle_sets(rows, size)
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    up = groups(ids, links)
    return sorted((i, len(sets[i]), up[i], up[i] == i) for i in ids)


def test_cosines_at_the_threshold_follow_the_formula(spark):
    """[1, 0] and [0.9, sqrt(0.19)] have the cosine 0.9 as dot / (norm * norm), less when both are scaled first."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8))
    z = rng.standard_normal((40, 8))
    z -= (z * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z * (np.linalg.norm(x, axis=1) / np.linalg.norm(z, axis=1))[:, None]
    pairs = [([1.0, 0.0], [0.9, 0.19**0.5]), ([1e-200, 0.0], [1e200, 0.0]), *zip(x.tolist(), y.tolist(), strict=True)]
    for a, b in pairs:
        raw = np.array([a, b])
        dot, norms = sum(p * q for p, q in zip(a, b, strict=True)), [sum(p * p for p in v) ** 0.5 for v in (a, b)]
        want = dot / (norms[0] * norms[1]) >= 0.9 if 0 < norms[0] and norms[1] < float("inf") else True
        assert embedding_caps.at_least(raw, embedding_caps._scaled(raw), 0.9)[0, 1] == want
    df = spark.createDataFrame([(1, pairs[0][0]), (2, pairs[0][1])], "vec_id long, embedding array<double>")
    assert [(r.n_links, r.component_id) for r in embedding_caps.near_duplicates(df).orderBy("vec_id").collect()] == [(1, 1), (1, 1)]


def test_signature_join(documents, monkeypatch):
    monkeypatch.setattr(signature_join, "LIST_BLOCK", 16)
    monkeypatch.setattr(signature_join, "FAMILY_BLOCK", 16)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):  # groups of copies from exact to about 0.7, one of them large
        base = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(80 if not texts else rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    shared = " ".join(rng.choices(words, k=25))
    texts += [f"{shared} {' '.join(rng.choices(words, k=30))}" for _ in range(60)]  # a passage that many share
    texts += ["", " \n", "One", "one", "two words", "two  WORDS", "É a b c", "é a b c", "a b c d", "a b c d e"]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = signature_join.near_duplicates(documents([*rows, (100000, None)]), size=4).collect()
    assert sorted(tuple(r) for r in got) == near([*rows, (100000, None)], 4)


def test_signature_join_null_ids_and_repeated_rows(documents):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (4, "A B C D E"), (9, "z"), (9, "y")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in signature_join.near_duplicates(documents(rows), size=4).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (5, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True), (9, 1, 9, True), (9, 1, 9, True)], key=str)
    assert signature_join.near_duplicates(documents([])).count() == 0


def test_signature_join_refuses_lower_similarities(documents):
    with pytest.raises(ValueError):
        signature_join.near_duplicates(documents([]), percent=50)


def test_estimate_of_matches():
    rng = np.random.default_rng(2)
    hits = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = np.unique(pool[:900]), np.unique(pool[100:])  # similarity 0.8
        x = signature_join.signature([a, b])
        hits.append(int((x[0] == x[1]).sum()))
    assert min(hits) >= signature_join.MATCHES + 2
    assert abs(np.mean(hits) / signature_join.COORDINATES - 0.8) < 0.03


def vectors(rng, dim):
    base = rng.standard_normal((40, dim))
    out = [base[k] for k in range(40)]
    for k in range(40):
        for _ in range(int(rng.integers(0, 5)) if k else 60):
            out.append(base[k] + rng.standard_normal(dim) * np.linalg.norm(base[k]) / np.sqrt(dim) * rng.uniform(0.05, 0.3))
    return out + [base[3] * 2, base[3] * 1e-3, base[5], base[5]]


@pytest.mark.parametrize("dim", [64, 7])
def test_embedding_caps(spark, monkeypatch, dim):
    monkeypatch.setattr(embedding_caps, "CELL", 16)
    v = vectors(np.random.default_rng(dim), dim)
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0]]
    rows = [(2 * i + 1, x.tolist(), 0) for i, x in enumerate(v)] + [(9001 + i, x, 1) for i, x in enumerate(odd)] + [(None, v[0].tolist(), 0)]
    got = {r.vec_id: tuple(r)[1:] for r in embedding_caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    x = np.array([r[1] for r in rows[: len(v)]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    ids = [r[0] for r in rows[: len(v)]]
    up = groups(ids, [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)])
    count = np.bincount(a, minlength=len(v)) + np.bincount(b, minlength=len(v))
    for k, i in enumerate(ids):
        assert got[i] == (count[k], up[i], up[i] == i)
    for i in range(len(odd)):
        assert got[9001 + i] == (0, 9001 + i, True)
    assert got[None] == (0, None, True)


def test_caps_recall_at_the_threshold():
    rng = np.random.default_rng(11)
    for n in (500, 1 << 16):
        code = embedding_caps.plan(n, 64, 0.9)
        x = embedding_caps._unit(rng, 300, 64)
        z = embedding_caps._unit(rng, 300, 64)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
        (r, m), (s, n2) = embedding_caps.decode(x, code), embedding_caps.decode(y, code)
        missed = sum(not set(m[r == k].tolist()) & set(n2[s == k].tolist()) for k in range(300))
        assert missed <= 6  # 2 %


def test_embeddings_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_caps.near_duplicates(none).count() == 0
    assert embedding_caps.near_duplicates(spark.range(1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))).count() == 1


def test_opened_signatures_are_never_handed_out_whole(spark, monkeypatch):
    """Spark takes a signature of 48 numbers for one, so a size that it estimates says nothing about the opened rows."""
    plans, write = [], signature_join.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(signature_join, "written", kept)
    rows = [(b"%d" % i, i, 90, [j if j < 30 else i * 100 + j for j in range(48)]) for i in range(6)]
    lists = signature_join.posted(write(spark.createDataFrame(rows, "mark binary, rep long, n_shingles long, sig array<int>"), "classes"))
    plans.append(lists._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    assert {(r.rep, r.df) for r in lists.collect()} == {(i, 6) for i in range(6)}
