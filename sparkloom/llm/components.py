"""Connected components of an edge table: union-find inside partitions, then star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that one union-find holds at a time; bounds its memory.
EDGES_AT_ONCE = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find (path halving, the smaller id becomes the root): each id with its root, for ids that are no root."""
    ids, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)].tolist(), idx[len(a) :].tolist()
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(x, y, strict=True):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    roots = np.array([find(i) for i in range(len(ids))], np.int64)
    child = roots != np.arange(len(ids))
    return ids[child], ids[roots[child]]


def _contracted(edges: DataFrame) -> DataFrame:
    def union(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            a, r = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(r)], ["a", "b"])

        for part in parts:
            held.append((part.column("a").to_numpy(zero_copy_only=False), part.column("b").to_numpy(zero_copy_only=False)))
            n += part.num_rows
            if n >= EDGES_AT_ONCE:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return edges.mapInArrow(union, "a bigint, b bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b): component is the smallest id that is reachable.

    Rounds of a large-star and a small-star step (groups by a key with partial minima, then a join that can be split)
    until each edge leads to its component's smallest id; ids without an edge are not in the result. Null ends are dropped."""
    at = stored(_contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")), "components", few=True)
    while True:
        # a > b holds for each edge; it is a forest of stars with the least id in the middle when no b is an a
        deep = at.select("b").distinct().join(at.select(F.col("a").alias("b")), "b", "left_semi")
        double = at.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo <> hi")
        if deep.isEmpty() and double.isEmpty():
            return at.distinct().select(F.col("a").alias("id"), F.col("b").alias("component")).union(at.select("b", F.col("b").alias("c")).distinct())
        both = at.union(at.select("b", "a")).distinct()
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = stored(_contracted(linked.union(small).filter("a <> b").distinct()), "components", few=True)
