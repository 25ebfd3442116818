"""The divergence audit against a plain count, its splitter against bytes.split, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import divergence as dv

SCHEMA = "doc_id long, lang string, source string, text string, rank int, term string"


def plain(rows, min_docs=3, top=200):
    """The contract, term by term, for rows (lang, source, text)."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(la or "", so or "", [w.translate(fold) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for la, so, t in rows]
    out = []
    for lang in {w[0] for w in words}:
        held = Counter(t for la, _, ws in words if la == lang for t in set(ws))
        kept = {t for t, n in held.items() if n >= min_docs}
        count = defaultdict(Counter)
        for la, so, ws in words:
            if la == lang:
                count[so].update(w for w in ws if w in kept)
        every = sum(count.values(), Counter())

        def p(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        q = p(every)
        for source in count:
            mine = p(count[source])
            pair = [(o, sum((mine[t] - other[t]) ** 2 // other[t] for t in kept)) for o in count if o != source for other in [p(count[o])]]
            term = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept if count[source][t] and mine[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, i, "x") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in dv.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_a_plain_count(spark):
    rng = random.Random(3)
    stems = ["Straße", "alpha", "alphabet", "alphabetical", "alphabetically", "b", "été", "x" * 40, "x" * 41, "Z"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", ""]), " ".join(rng.choices(stems, k=rng.randint(0, 9)))) for _ in range(90)]
    rows += [("en", "hot", "alpha Beta beta")] * 40 + [("fr", "empty", None), ("fr", "blank", "12 34"), (None, None, None), ("en", "long", "alpha-" * 20_000 + "y" * 9_000)]
    assert audited(spark, rows) == plain(rows)
    assert audited(spark, rows, min_docs=1, top=2) == plain(rows, 1, 2)


def test_tables_without_rows_or_terms(spark):
    assert audited(spark, [("en", "a", "x")] * 0) == []
    assert audited(spark, [("en", "a", None), ("en", "b", "...")]) == plain([("en", "a", ""), ("en", "b", "")])


def test_a_prefix_counts_a_document_once(spark):
    """Two documents with six terms behind one prefix: the prefix is dropped at the first level."""
    terms = [("prefixed" + c).encode() for c in "abc"]
    told = spark.createDataFrame([("en", bytearray(t), [1, 2]) for t in terms], "lang string, term binary, docs array<long>")
    assert dv.prefixes(told, 8, 3).count() == 0
    assert dv.prefixes(told.withColumn("docs", F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>")), 8, 3).count() == 1


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_terms_of_a_slice(kind):
    rng = random.Random(1)
    keep = bytes(dv.FOLD.tolist())
    for _ in range(500):
        texts = ["".join(rng.choice("aB \n1é\x85\xa0_") for _ in range(rng.choice([0, 0, 1, 3, 9]))).encode() for _ in range(rng.randint(0, 6))]
        found, sizes = dv.terms_of(pa.array([b"junk x", *texts], kind).slice(1))
        split = [t.translate(keep).split() for t in texts]
        assert found.to_pylist() == [w for s in split for w in s] and list(sizes) == [len(s) for s in split]


def test_shares_are_exact(spark):
    rows = [(0, 0, 1), (10**13, 10**13, 7), (123_456_789_012, 9_000_000_000_000, 54_321), (2, 5, 2)]
    df = spark.createDataFrame(rows, "n long, total long, v long")
    got = [r[0] for r in df.select(dv.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]
