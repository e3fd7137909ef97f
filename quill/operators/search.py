"""Exact cosine top-k for many queries (F11), with cells that the triangle inequality rules out.

Vectors are scaled to length one, where the squared distance is 2 - 2 cos.
Centres (k-means on a bounded sample) cut the vectors into cells, each with the
largest distance to its centre.  A query first searches the cells nearest to it
until they hold ``k`` vectors; the k-th best of those bounds the distance that
still counts.  Then it visits every cell that can hold a nearer vector: the
distance to the centre less the cell's radius is within the bound.  What is left
out cannot be among the best, so the result is that of comparing all pairs.

A cell is searched in parts of at most ``PART`` vectors by parts of at most
``PART`` queries, each pair of parts one block product in a task, so a cell with
a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.session import staged

SAMPLE, MOST_CELLS, ROUNDS, PART = 20_000, 256, 8, 8192
# Rows of a (row, cell) table, visits given out and (query, vector) scores that a task holds at once.
TABLE_ROWS, VISITS, SCORES = 2048, 1 << 14, 1 << 21
# Rounding of distances in single steps of double arithmetic, with a margin.
SLACK = 1e-9


def unit_rows(col: pa.Array, dim: int) -> np.ndarray:
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into ``TABLE_ROWS``."""
    for b in batches:
        for at in range(0, b.num_rows, TABLE_ROWS):
            yield b.slice(at, TABLE_ROWS)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of ``a`` and ``b``."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means centres of the sample."""
    rng = np.random.default_rng(0)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = distances(sample, c).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Cells(NamedTuple):
    """The written vectors (key, v, cell, part) and the cells' centres, sizes and radii."""

    vectors: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    dim: int


def build_cells(vectors: DataFrame, key: str, vec: str, cells: int | None = None) -> Cells:
    """Cells of the vectors that are neither null nor of another length than the first.

    Vectors of length zero have cosine 0 with everything; they keep the distance 1 that they have
    from every unit vector and are found like the others.
    """
    v = vectors.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")).filter(
        "v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    v = staged(v, "search-vectors")
    n = v.count()
    if not n:
        raise ValueError("no vectors")
    some = v.select("v").sample(min(1.0, 1.2 * SAMPLE / n), seed=1).limit(SAMPLE).collect() or v.select("v").head(1)
    dim = len(some[0]["v"])
    x = np.array([r["v"] for r in some if len(r["v"]) == dim])
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    centres = centres_of(x / np.where(length > 0, length, 1), cells or min(MOST_CELLS, max(1, int(np.sqrt(n)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            d = distances(unit_rows(b.column(1), dim), centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)),
                                              pa.array(d[np.arange(len(cell)), cell])], names=["key", "v", "cell", "far"])

    kind = v.schema["key"].dataType.simpleString()
    placed = v.filter(F.size("v") == dim).mapInArrow(assign, f"key {kind}, v array<double>, cell int, far double")
    placed = staged(placed, "search-cells")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[r.cell], radii[r.cell] = r.n, r.far
    return Cells(placed, centres, sizes, radii, dim)


class Found(NamedTuple):
    """The best (query, rank, key, score), and the share of all pairs of query and vector that were compared."""

    rows: DataFrame
    compared: float


def search(cells: Cells, queries: DataFrame, key: str, vec: str, k: int = 10) -> Found:
    """For every row of ``queries`` its ``k`` nearest vectors by cosine; equal scores go by key."""
    q = queries.select(F.col(key).alias("query"), F.col(vec).cast("array<double>").alias("q")).filter(
        f"q IS NOT NULL AND size(q) = {cells.dim} AND NOT exists(q, x -> x IS NULL)")
    q = staged(q, "search-queries")
    n_queries = q.count()
    kind = cells.vectors.schema["key"].dataType.simpleString()
    q_kind = q.schema["query"].dataType.simpleString()
    sizes, radii, centres, dim = cells.sizes, cells.radii, cells.centres, cells.dim

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells nearest to each query that together hold k vectors."""
        for b in _slices(batches):
            d = distances(unit_rows(b.column(1), dim), centres)
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, at = np.nonzero((before < k) & (sizes[order] > 0))
            yield from _visits(b, row, order[row, at])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells not yet visited that can hold a vector within each query's bound."""
        for b in _slices(batches):
            d = distances(unit_rows(b.column(1), dim), centres)
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            seen = np.zeros(d.shape, bool)
            np.put_along_axis(seen, order, (before < k) & (sizes[order] > 0), axis=1)
            bound = b.column(2).to_numpy(zero_copy_only=False)[:, None]
            row, cell = np.nonzero(~seen & (sizes > 0) & (d - radii <= bound + SLACK))
            yield from _visits(b, row, cell)

    visit = f"query {q_kind}, q array<double>, cell int"
    first = staged(q.mapInArrow(near, visit), "search-first")
    best = staged(_compare(cells, first, k, kind, q_kind), "search-best")
    bound = best.filter(F.col("rank") == k).select("query", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))
    rest = q.join(bound, "query", "left").select("query", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    second = staged(rest.mapInArrow(others, visit), "search-second")
    rows = best.select("query", "key", "score").unionByName(_compare(cells, second, k, kind, q_kind).select("query", "key", "score"))
    visits = {r.cell: r["count"] for r in first.select("cell").unionByName(second.select("cell")).groupBy("cell").count().collect()}
    compared = sum(n * int(sizes[c]) for c, n in visits.items()) / max(1, n_queries * int(sizes.sum()))
    return Found(_ranked(rows, k), compared)


def _visits(b: pa.RecordBatch, row: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each visit carries its query's vector, so a batch may become many times its size."""
    for i in range(0, len(row), VISITS):
        at = pa.array(row[i:i + VISITS])
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell[i:i + VISITS].astype(np.int32))],
                                         names=["query", "q", "cell"])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _compare(cells: Cells, visits: DataFrame, k: int, kind: str, q_kind: str) -> DataFrame:
    """The best k of each query among the vectors of the cells it visits."""
    # parts by hash: a part of a cell holds about PART rows, on either side
    counts = visits.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("q_parts"))
    v_parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // PART))) for n in cells.sizes]), F.col("cell") + 1)
    v = cells.vectors.join(counts, "cell").select(
        "cell", F.pmod(F.xxhash64("key"), v_parts).cast("int").alias("vp"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("qp"),
        "key", "v")
    q = visits.join(counts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), v_parts - 1)).alias("vp"), F.pmod(F.xxhash64("query"), F.col("q_parts")).cast("int").alias("qp"),
        "query", "q")

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "key": [], "score": []})
        left = left.sort_values("key", kind="stable")
        a, b = np.stack(right["q"].to_numpy()), np.stack(left["v"].to_numpy())
        at, score = best_of(a, b, k)
        return pd.DataFrame({"query": np.repeat(right["query"].to_numpy(), at.shape[1]), "key": left["key"].to_numpy()[at.ravel()],
                             "score": score.ravel()})

    pairs = v.groupBy("cell", "vp", "qp").cogroup(q.groupBy("cell", "vp", "qp")).applyInPandas(
        block, f"query {q_kind}, key {kind}, score double")
    return _ranked(pairs, k)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``a`` with every row of ``b``; 0 for rows of zeros."""
    la, lb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    return (a / np.where(la > 0, la, 1)[:, None]) @ (b / np.where(lb > 0, lb, 1)[:, None]).T


def best_of(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` its ``k`` nearest rows of ``b`` and their cosines.

    The scores of two whole parts would be half a gigabyte and their order as much again: ``SCORES`` at once.
    """
    top, step = min(k, len(b)), max(1, SCORES // len(b))
    best, scores = [], []
    for i in range(0, len(a), step):
        cos = cosines(a[i:i + step], b)
        # copied: a view would keep the order of all
        at = np.argsort(-cos, axis=1, kind="stable")[:, :top].copy() if top < len(b) else np.tile(np.arange(len(b)), (len(cos), 1))
        best.append(at)
        scores.append(np.take_along_axis(cos, at, 1))
    return np.concatenate(best), np.concatenate(scores)


def cosine_topk_many(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int = 10) -> Found:
    """F11 for a table of queries."""
    return search(build_cells(vectors, key, vec), queries, key, vec, k)
