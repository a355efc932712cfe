"""Connected components of a table of edges, by alternating large-star and small-star steps.

No links reach the driver. Every round is written to the shared folder, so a lost executor costs
one round at most; minima are combined before the shuffle. A node with more neighbours than a task's
share of all edges takes its minimum by broadcast, so its edges never meet in one task. Up to
FEW edges, which are counted first, are joined in one task of an executor without any round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise


#: Edges (16 bytes each) that one task takes whole.
FEW = 1_000_000


class Union:
    """Union-find over any hashable keys; the smallest key leads."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as stars around the smallest node of its local components."""
    for batch in batches:
        union = Union()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            union.join(a, b)
        nodes = np.fromiter(union.up, np.int64, len(union.up))
        roots = np.fromiter((union.find(x) for x in union.up), np.int64, len(union.up))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a partition as stars around the smallest node of each component."""
    tables = list(batches)
    if tables:
        yield from _local([pa.Table.from_batches(tables).combine_chunks().to_batches()[0]] if sum(t.num_rows for t in tables) else [])


def _sum(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"]


def _beside_minimum(rows: DataFrame, key: str, value: str, least: Column, share: int) -> DataFrame:
    """rows with m, the aggregate least over the rows of their key.

    At most count(rows) / share keys have more than share rows each; only those are broadcast, and
    their rows stay where they are. The rows of all other keys are joined by a shuffle.
    """
    each = rows.groupBy(key).agg(least.alias("m"), F.count("*").alias("n"))
    hubs = each.filter(F.col("n") > share).select(F.col(key).alias("hub"), F.col("m").alias("hub_m"))
    told = rows.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left")
    hot = told.filter("hub is not null").select(key, value, F.col("hub_m").alias("m"))
    rest = told.filter("hub is null").select(key, value)
    return rest.join(each.filter(F.col("n") <= share).select(key, "m"), key).select(key, value, "m").unionByName(hot)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of an edge; edges has bigint a and b."""
    known = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(known.mapInArrow(_local, "a bigint, b bigint").distinct(), "edges")
    mark = _sum(now)
    if 0 < mark[0] <= FEW:
        now, mark = now.coalesce(1).mapInArrow(_whole, "a bigint, b bigint"), (0, 0)
        now = materialise(now, "stars")
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while mark[0]:
        share = max(64, mark[0] // tasks)  # hubs: at most two for each task
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        beside = _beside_minimum(both, "u", "v", F.least(F.col("u"), F.min("v")), share)
        large = beside.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        paired = _beside_minimum(large, "a", "b", F.min("b"), share)
        small = paired.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        small = materialise(small, "small")
        after = _sum(small)
        forget(large)
        forget(now)
        now = small
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
