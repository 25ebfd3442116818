"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction: the vectors whose inner product with it reaches a height lie in its cap. Directions are products: the
randomly rotated space is cut in two, each half has ``words`` random unit vectors, and a direction takes one of each. Each
vector is decoded to the list of all directions whose caps hold it, without trying all: only words that the best
word of the other half can lift to the height are combined. ROTATIONS such codes make the number of shared caps even
between pairs. Vectors are joined on directions; pairs are verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.cells import dealt, each_cell
from tablewright.llm.common import id_type, table, written
from tablewright.llm.components import Forest, components
from tablewright.llm.registry import query

ROTATIONS = 32
#: Chance that two vectors exactly at the similarity threshold share no cap; above the threshold it falls quickly.
MISS = 1e-3
CELL = 400  # vectors of one cap in one block
CLOSE = 1e-12  # cosines this close to the threshold are decided by the formula itself
SEED = 20240301


@dataclass(frozen=True)
class Code:
    """What decides the filters: dimensions, words of each half, height of the caps."""

    dim: int
    words: int
    height: float


@lru_cache(64)
def directions(dim: int, words: int, rotation: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the words of its two halves; the same on every machine."""
    rng = np.random.default_rng([SEED, dim, words, rotation])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    left, right = _unit(rng, words, max(1, dim // 2)), _unit(rng, words, dim - dim // 2)
    return q * np.sign(np.diag(r)), left, right


def _unit(rng, n: int, dim: int) -> np.ndarray:
    v = rng.standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _products(x: np.ndarray, code: Code, rotation: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products with the words of each half; those of a direction are their sum."""
    q, left, right = directions(code.dim, code.words, rotation)
    y, half = x @ q / np.sqrt(2), code.dim // 2
    return (y[:, :half] @ left.T if half else np.zeros((len(x), code.words))), y[:, half:] @ right.T


def decode(x: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all directions with an inner product of at least ``height``, sorted by row and number."""
    rows, numbers = [], []
    for rotation in range(ROTATIONS):
        a, b = _products(x, code, rotation)
        ra, ia = np.nonzero(a >= (code.height - b.max(1))[:, None])
        rb, ib = np.nonzero(b >= (code.height - a.max(1))[:, None])
        many = np.bincount(rb, minlength=len(x))
        first = np.cumsum(many) - many
        size = many[ra]
        to = np.cumsum(size)
        if not len(to) or not to[-1]:
            continue
        left = np.repeat(np.arange(len(ra)), size)
        right = np.arange(to[-1]) + np.repeat(first[ra] - (to - size), size)
        hit = a[ra, ia][left] + b[rb, ib][right] >= code.height
        left, right = left[hit], right[hit]
        rows.append(ra[left])
        numbers.append((rotation * code.words + ia[left]) * code.words + ib[right])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, number = np.concatenate(rows), np.concatenate(numbers)
    order = np.lexsort((number, row))
    return row[order], number[order]


@lru_cache(8)
def plan(n: int, dim: int, threshold: float) -> Code:
    """The code for ``n`` vectors: 2 * sqrt(n) words a half, so that unrelated vectors rarely meet, and the height for MISS.

    400 random pairs at the threshold tell at which height a pair shares a cap of one code; by the random rotation any pair
    at that angle behaves like these.
    """
    words = max(16, int(np.ceil(2 * np.sqrt(max(n, 1)))))
    rng = np.random.default_rng([SEED, dim, 7])
    x = _unit(rng, 400, dim)
    y = x
    if dim > 1:
        z = _unit(rng, 400, dim)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z
    (a, b), (c, d) = (_products(v, Code(dim, words, 0), ROTATIONS) for v in (x, y))
    best = []
    for p, q, r, s in zip(a, b, c, d, strict=True):  # the best combinations have a good word on either side
        i, j = np.argsort(-np.minimum(p, r))[:256], np.argsort(-np.minimum(q, s))[:256]
        best.append(np.minimum(p[i][:, None] + q[j], r[i][:, None] + s[j]).max())
    return Code(dim, words, float(np.quantile(best, MISS ** (1 / ROTATIONS))))


def classes_of(df: DataFrame) -> DataFrame:
    """(rep, many, dim, v): the distinct usable vectors, with their smallest vec_id and how many rows have them."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select("vec_id", F.col("embedding").alias("v")).where("vec_id IS NOT NULL").where(usable)
    return rows.groupBy("v").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("many")).select("rep", "many", F.size("v").alias("dim"), "v")


def posted(classes: DataFrame, codes: dict[int, Code]) -> DataFrame:
    """(rep, dim, caps): the numbers of the caps that hold each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, lists = b.column("dim").to_numpy(), b.column("v")
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                some = lists.take(pa.array(at))
                x = np.asarray(some.flatten(), float).reshape(-1, dim)
                rep = b.column("rep").take(pa.array(at))
                for lo in range(0, len(x), 200):
                    part = _scaled(x[lo : lo + 200])
                    row, number = decode(part, codes[dim])
                    at = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                    caps = pa.ListArray.from_arrays(pa.array(at), pa.array(number, pa.int64()))
                    yield pa.RecordBatch.from_arrays([rep.slice(lo, len(part)), pa.array([dim] * len(part), pa.int32()), caps], ["rep", "dim", "caps"])

    return classes.select("rep", "dim", "v").mapInArrow(run, "rep long, dim int, caps array<long>")


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_least(raw: np.ndarray, scaled: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have dot(a, b) / (|a| * |b|) >= ``threshold``, above the diagonal.

    The scaled vectors decide all pairs but those within rounding of the threshold; these are decided by the formula itself on the vectors as they are, with sums from
    left to right, unless that overflows or vanishes.
    """
    cosine = scaled @ scaled.T
    near = np.triu(cosine >= threshold, 1)
    i, j = np.nonzero(np.triu(np.abs(cosine - threshold) < CLOSE, 1))
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.add.accumulate(raw * raw, axis=1)[:, -1]) if len(i) else None
        for lo in range(0, len(i), 10_000):
            a, b = i[lo : lo + 10_000], j[lo : lo + 10_000]
            size = norm[a] * norm[b]
            exact = np.add.accumulate(raw[a] * raw[b], axis=1)[:, -1] / size
            sure = np.isfinite(exact) & np.isfinite(size) & (size > 1e-200)
            near[a, b] = np.where(sure, exact, cosine[a, b]) >= threshold
    return near


def verified(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b, weight): links of a spanning forest per cell (weight null), and per vector the links found there (b null).

    A link is counted in the first cap that both vectors share and nowhere else; no pair leaves the task.
    """

    def compare(t: pa.Table) -> tuple[list, list, list]:
        rep, many, block = t.column("rep").to_numpy(), t.column("many").to_numpy(), t.column("block").to_numpy()
        g, cap = len(rep), t.column("cap")[0].as_py()
        whole = t.column("cell_i")[0].as_py() == t.column("cell_j")[0].as_py()
        if g < 2:
            return [], [], []
        split = 0 if whole else int(np.searchsorted(block, block[-1]))
        raw = np.asarray(t.column("v").combine_chunks().flatten(), float).reshape(g, -1)
        near = at_least(raw, _scaled(raw), threshold)
        if not whole:
            near[:split, :split] = near[split:, split:] = False
        if not near.any():
            return [], [], []
        caps = t.column("caps").combine_chunks()
        flat, size = np.asarray(caps.flatten()), np.diff(caps.offsets.to_numpy())
        who = np.repeat(np.arange(g), size)
        before = flat < cap
        _, code, count = np.unique(flat[before], return_inverse=True, return_counts=True)
        some = np.flatnonzero(count > 1)
        if len(some):
            place = np.full(len(count), -1)
            place[some] = np.arange(len(some))
            keep = place[code] >= 0
            held = np.zeros((g, len(some)), np.float32)
            held[who[before][keep], place[code][keep]] = 1
            near &= held @ held.T == 0
        a, b = np.nonzero(near)
        if not len(a):
            return [], [], []
        found = np.bincount(a, many[b], g) + np.bincount(b, many[a], g)
        forest = Forest(g)
        forest.join_all(a, b)
        out = [(int(rep[i]), int(rep[j]), None) for i, j in forest.kept] + [(int(rep[i]), None, int(found[i])) for i in np.flatnonzero(found)]
        return tuple(map(list, zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, weight in each_cell(batches, "group", compare):
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, weight)], ["a", "b", "weight"])

    # the group is a cap of vectors of one length; numbers of different lengths can be equal
    named = lists.withColumn("group", F.concat_ws(":", "dim", "cap"))
    cells = dealt(named, "group", F.ceil(F.col("n") / CELL), F.col("rep"))
    return cells.mapInArrow(run, "a long, b long, weight long")


def near_duplicates(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``df`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs with a cosine of at least ``threshold`` in double precision, whatever other columns say; none below is ever
    returned, and a pair at the threshold is missed with a chance of about 1e-3 to 2e-3. Rows with a null, empty or zero vector, with null or
    non-finite components, or without vec_id have no links; vectors of different lengths have none either. Equal vectors are
    handled as one and linked with each other. component_id is the smallest vec_id that links reach (null for a null id), kept marks its row.
    The driver gets the row count of each vector length. Any cap, however full, is compared whole, in cells of bounded size.
    """
    classes = written(classes_of(df), "vector-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    codes = {dim: plan(1 << max(0, n - 1).bit_length(), dim, threshold) for dim, n in sizes.items()}
    spread = written(posted(classes, codes), "caps")
    each = spread.select("rep", "dim", F.explode("caps").alias("cap"))
    full = each.groupBy("dim", "cap").agg(F.count("*").alias("n")).where("n > 1")
    lists = each.join(full, ["dim", "cap"]).join(spread.join(classes.select("rep", "many", "v"), "rep").drop("dim"), "rep")
    found = written(verified(lists, threshold), "vector-links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("weight").alias("others"))
    groups = components(found.where("b IS NOT NULL"))
    by_class = (
        classes.join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("v", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rows = df.select("vec_id", F.col("embedding").alias("w"))
    joined = rows.join(by_class, (F.col("w") == F.col("v")) & F.col("vec_id").isNotNull(), "left")
    own = F.col("vec_id").cast("long")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id")).withColumn(
        "kept", F.coalesce(own == F.col("component_id"), F.lit(True))
    )


SQL = """
WITH RECURSIVE d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM d
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT d.vec_id, (SELECT count(*) FROM l WHERE l.a = d.vec_id) AS n_links, m.c AS component_id, m.c = d.vec_id AS kept FROM d JOIN m USING (vec_id)"""


@query("op1_embedding_caps", SQL)
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
