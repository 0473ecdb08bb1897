"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import column, forget, map_arrow, store

#: Edges that a task contracts at once, and edges of a written partition.
CHUNK = 300_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("g")).first()
    return tuple(r)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, a chunk at a time, as stars on the least node that each reaches within the chunk."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > CHUNK:
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, component for every node with an edge: the least node that it reaches.

    edges has columns a, b (long), any order, any number of times.  Tasks contract what they have of the edges to stars
    first, which takes paths that lie in one task together.  Each star step then hangs neighbours on the least node
    around, so paths shorten geometrically; every step's table is written in the shared folder, in as many files as its
    edges need; only counts and sums come to the driver, and a node with many neighbours is a splittable side of a join.
    """
    few = map_arrow(edges.select("a", "b").filter("a <> b"), _contracted, "a long, b long")
    now = store(few.distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = _mark(now)
        if mark == before or not mark[0]:
            break
        before = mark
        files = 1 + mark[0] // CHUNK
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store(large.coalesce(files), "large-star")
        forget(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(files), "small-star")
        forget(large)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
