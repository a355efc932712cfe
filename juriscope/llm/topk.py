"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integer term weights (one term per dimension). Documents are numbered so that similar
ones are neighbours (by the nearest of a few centres) and cut into blocks of neighbours; a block keeps
a forward index (its weight matrix) and each term's maximum and minimum. For a query the bound of a
block is the sum over terms of the largest product the block can reach. Every query starts with the
k-th score that it reaches among a bounded number of documents spread over all centres, so all tasks
prune by it from their first block. A task takes its blocks in falling order of their bounds, scores a
block through its forward index, and stops for a query once the next bound falls below its k-th score.

Numbering and starting scores decide only how much is pruned, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Rows in one block of the forward index.
BLOCK_ROWS = 256
#: Bytes of queries searched (and broadcast) at once; more queries take more passes.
QUERY_BYTES = 32 << 20
#: Centres by which documents are numbered, and documents at most from which they and the first k-th scores are taken.
CENTRES = 64
SEEDS = 4096
#: Sums of products below this are exact in doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, no null component, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) as doubles that hold integers; short vectors are filled with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * float(scale))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; beyond 64 bits they saturate."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
    return np.array([[max(-_LONG, min(_LONG, v)) for v in row] for row in whole], np.int64).reshape(len(q), len(x))


def _widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.hstack([m, np.zeros((len(m), width - m.shape[1]))])


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * queries
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * queries
        # least: scores that k candidates are known to reach, wherever those are
        self.k, self.kth = k, np.full(queries, -np.inf) if least is None else least.astype(np.float64)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores[query], self.ids[query] = s[order], i[order]
        if len(order) == self.k:
            self.kth[query] = max(self.kth[query], float(s[order[-1]]))


def search_blocks(blocks: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, query_ids: np.ndarray, k: int, best: _Best, counts: list[int]) -> None:
    """Take (ids, matrix) blocks by falling bound for every query; counts gets [scored, skipped] pairs of query and block."""
    width = max([queries.shape[1], *(m.shape[1] for _, m in blocks)])
    q = _widen(queries, width)
    blocks = [(i, _widen(m, width)) for i, m in blocks]
    high, low = np.array([m.max(axis=0) for _, m in blocks]), np.array([m.min(axis=0) for _, m in blocks])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bounds += np.abs(bounds) * 1e-9  # doubles may round
    order = np.argsort(-bounds, axis=1, kind="stable")
    for nth in range(len(blocks)):
        which = order[:, nth]
        live = bounds[np.arange(len(q)), which] >= best.kth
        counts[0] += int(live.sum())
        counts[1] += int((~live).sum())
        if not live.any():
            counts[1] += int(len(q) * (len(blocks) - nth - 1))
            break
        for b in np.unique(which[live]):
            rows = np.flatnonzero(live & (which == b))
            ids, matrix = blocks[b]
            scores = _products(q[rows], matrix)
            for r, s in zip(rows, scores, strict=True):
                other = ids != query_ids[r]
                good = other & (s >= best.kth[r])
                if good.any():
                    best.add(int(r), s[good], ids[good])


def _centres(x: np.ndarray, most: int) -> np.ndarray:
    """Unit centres of the rows by a few rounds of spherical k-means, begun at evenly spaced rows."""
    norms = np.linalg.norm(x, axis=1)
    x = x[norms > 0] / norms[norms > 0, None]
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)]
    for _ in range(8):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; rows may be shorter or longer than the centres."""
    width = min(x.shape[1], centres.shape[1])
    if not width or not len(x):
        return np.zeros(len(x), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(x[:, :width] @ centres[:, :width].T).argmax(axis=1)


_OUT = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def numbered(vectors: DataFrame, seeds: tuple[np.ndarray, np.ndarray], scale: int) -> DataFrame:
    """vec_id, v, centre of usable vectors, range-partitioned by (centre, vec_id): the order of the blocks.

    A centre that holds many rows fills many partitions, since vec_id and the vector's hash divide it.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    centres = _centres(seeds[1], CENTRES)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _near(_matrix(batch.column("v").to_pylist(), scale), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "v", "centre"])

    rows = rows.mapInArrow(assign, "vec_id bigint, v array<double>, centre int")
    return materialise(rows.repartitionByRange("centre", "vec_id", F.xxhash64("v")).sortWithinPartitions("centre", "vec_id"), "vectors")


def _seeds(vectors: DataFrame, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, weights) of at most SEEDS usable vectors: those whose hash is least, so the choice does not depend on the partitions."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    chosen = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SEEDS).toArrow()
    return chosen.column("vec_id").to_numpy(), _matrix(chosen.column("v").to_pylist(), scale)


def _begin(q: np.ndarray, query_ids: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """For each query the k-th score that seeds with another id reach; none where there are fewer than k."""
    ids, x = seeds
    out = np.full(len(q), -np.inf)
    if len(ids) < k:
        return out
    width = max(q.shape[1], x.shape[1])
    q, x = _widen(q, width), _widen(x, width)
    for at in range(0, len(q), 256):
        scores = _products(q[at : at + 256], x).astype(np.float64)
        scores[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        out[at : at + 256] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, report: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for every row of queries, exactly.

    Both tables have vec_id and embedding. Vectors that are null or hold a null or non-finite
    component, and rows without vec_id, take no part; missing components count as zero; a query's
    candidates are the rows with another vec_id, rows that repeat a vec_id being candidates each;
    queries that repeat exactly are asked once; ties go to the smaller vec_id; scores beyond 64 bits
    saturate; empty tables give an empty result; other columns are not read.

    Queries are asked in passes of QUERY_BYTES: a pass is broadcast, its results are written and its
    broadcast is dropped before the next one begins. ``report`` takes a row (scored, skipped) of pairs
    of query and block for each pass.
    """
    spark = vectors.sparkSession
    seeds = _seeds(vectors, scale)
    rows = numbered(vectors, seeds, scale)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("query_id").isNotNull()).distinct()
    asked = materialise(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") * 8 + 64), F.lit(0)).alias("bytes")).first()
    passes = max(1, math.ceil(size["bytes"] / QUERY_BYTES))
    found = None
    for p in range(passes):
        some = (asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == p) if passes > 1 else asked).orderBy("query").toArrow()
        matrix = _matrix(some.column("v").to_pylist(), scale)
        ids, names = some.column("query_id").to_numpy(), some.column("query").to_numpy()
        shared = spark.sparkContext.broadcast((matrix, ids, names, _begin(matrix, ids, seeds, k)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matrix, ids, names, least = shared.value
            if not len(ids):
                return
            best, counts = _Best(len(ids), k, least), [0, 0]
            for batch in batches:  # a batch is a run of neighbouring blocks; thresholds carry over
                own, rest = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
                blocks = [(own[i : i + BLOCK_ROWS], _matrix(rest[i : i + BLOCK_ROWS], scale)) for i in range(0, len(rest), BLOCK_ROWS)]
                if blocks:
                    search_blocks(blocks, matrix, ids, k, best, counts)
            # a row without query carries the counts of pairs scored and skipped
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([counts[0]]), pa.array([counts[1]])], schema=_OUT)
            for i, name in enumerate(names):
                if len(best.ids[i]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids[i]), name, np.int64)), pa.array(best.ids[i]), pa.array(best.scores[i])], schema=_OUT)

        part = materialise(rows.mapInArrow(search, "query bigint, vec_id bigint, score bigint"), f"best-{p}")
        shared.unpersist()
        if report is not None:
            report.append(tuple(part.filter("query is null").agg(F.coalesce(F.sum("vec_id"), F.lit(0)), F.coalesce(F.sum("score"), F.lit(0))).first()))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.filter("query is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select("query", "query_id")
    names = F.broadcast(names) if size["n"] <= 1_000_000 else names
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_k(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
