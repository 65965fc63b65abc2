"""Centroid clustering by delta Lloyd, in whole numbers.

Vectors become integers, so sums, floors and distances are exact and come out alike in any order of the rows. Each vector's owner and
distance are stored beside it, and each centroid's sum and count are kept over the rounds. A round compares a vector whose owner stayed
where it was only with the centroids that moved: all others are no nearer than they were. A vector whose owner moved is compared with all of them. Vectors
that change hands are written apart from the others; only they are read again, and each task sends, for each centroid, one signed sum of what it
gains and loses. When no centroid moves, the remaining rounds can change nothing and are left out.

Centroids (k x dims numbers, both parameters) go to every task; no shuffle has more than k rows from a task.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out; repeated rows, and rows
that share an id, are vectors of their own; a null id is an id like others, but the last when centroids are picked. With fewer vectors
than k there are as many centroids as vectors; without any there are no rows. Components beyond +-LARGEST after scaling are an error, as
squares of them would not fit. Other columns stay as they are; those that are named like ADDED are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import Scratch, new_folder, stored

#: Dimensions, scale, centroids, rounds and seed of the query.
DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest component: a distance over 64 of them, and sums over 2^36 vectors, fit into 64 bits.
LARGEST = 1 << 26
#: Up to this component products in double precision are exact, and matrix multiplication does the work.
EXACT = 1 << 22
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
#: Vectors that a task compares at a time.
BLOCK = 4096


def integers(df: DataFrame, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """Rows with a vector of `dims` finite components: the row as a struct `__row`, and `q`, floor(scale * x) of each."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), F.transform(F.col(vector).cast("array<double>"), lambda x: x).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter((F.size("x") == dims) & fine)
    scaled = lambda x: F.floor(x * F.lit(float(scale)))
    checked = F.when(F.exists("x", lambda x: F.abs(x * F.lit(float(scale))) > LARGEST), F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling")).cast("array<int>"))
    return rows.select("__row", checked.otherwise(F.transform("x", lambda x: scaled(x).cast("int"))).alias("q"))


def first_centroids(vectors: DataFrame, id_col: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least digest of `seed:id`; of equal ids the lesser components first. At most k rows come to the driver."""
    at = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__row")[id_col].cast("string")), 256)
    return [r["q"] for r in vectors.select(at.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()]


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT
    cross = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64) if small else x @ centroids.T
    return (x * x).sum(1)[:, None] - 2 * cross + (centroids * centroids).sum(1)[None, :]


def compared(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids `moved` (a mask) have moved. An owner of -1 is none yet. Of equal distances the smaller number wins."""
    anew = (owner < 0) | moved[np.maximum(owner, 0)]
    out, dist = owner.copy(), distance.copy()
    if anew.any():
        d = distances(x[anew], centroids)
        out[anew] = d.argmin(1)
        dist[anew] = d.min(1)
    rest = np.flatnonzero(~anew)
    if len(rest) and moved.any():
        numbers = np.flatnonzero(moved)
        d = distances(x[rest], centroids[numbers])
        best = d.argmin(1)
        near, number = d[np.arange(len(rest)), best], numbers[best]
        better = (near < dist[rest]) | ((near == dist[rest]) & (number < out[rest]))
        out[rest[better]], dist[rest[better]] = number[better], near[better]
    return out, dist


def _assigned(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """rows with the owners and distances of a round, and `was`, the owner before. Those whose owner is another one lie in a part of the stored table
    of their own (`changed`)."""
    dims = centroids.shape[1]
    schema = StructType([f for f in rows.schema.fields if f.name in ("__row", "q")]).add("cluster", IntegerType()).add("distance", LongType()).add("was", IntegerType())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for low in range(0, whole.num_rows, BLOCK):
                part = whole.slice(low, BLOCK)
                was, before = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "distance"))
                owner, dist = compared(_matrix(part.column("q"), dims), was, before, centroids, moved)
                yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("q"), pa.array(owner, pa.int32()), pa.array(dist, pa.int64()), pa.array(was, pa.int32())], schema.names)

    out = rows.select("__row", "q", "cluster", "distance").mapInArrow(run, schema).withColumn("changed", F.col("cluster") != F.col("was"))
    path = new_folder(rows.sparkSession, "clusters")
    out.write.partitionBy("changed").parquet(path)
    again = rows.sparkSession.read.schema(out.schema).parquet(path)
    again._folder = path
    return again


def transfers(rows: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster, n, total): what each centroid gains, and loses, by the vectors that changed hands, as signed whole numbers. A task adds up its own
    vectors and sends a row a centroid."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for part in parts:
            x = _matrix(part.column("q"), dims)
            for column, sign in (("cluster", 1), ("was", -1)):
                owner = part.column(column).to_numpy(zero_copy_only=False)
                np.add.at(n, owner[owner >= 0], sign)
                np.add.at(total, owner[owner >= 0], sign * x[owner >= 0])
        some = np.flatnonzero((n != 0) | (total != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sent = rows.filter("changed").select("q", "cluster", "was").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    return sent.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))


def delta_lloyd(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(df's rows with cluster, distance, q and the struct `__row`, the final centroids). Stored; see the module for rows that are left out."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        start = stored(integers(df, vector, dims, scale).withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long")}), "vectors")
        centroids = np.array(first_centroids(start, id_col, k, seed), np.int64).reshape(-1, dims)
        if not len(centroids):
            return scratch.keep(start), []
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        rows, moved = start, np.ones(len(centroids), bool)
        for step in range(rounds + 1):
            last, rows = rows, _assigned(rows, centroids, moved)
            scratch.drop(last)
            if step == rounds:
                break
            for r in transfers(rows, len(centroids), dims).collect():  # a row a centroid
                count[r["cluster"]] += r["n"]
                total[r["cluster"]] += np.array(r["total"], np.int64)
            new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
            moved = (new != centroids).any(1)
            centroids = new
            if not moved.any():
                break
        return scratch.keep(rows), centroids.tolist()


def clustered(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """df's rows, but for those that are left out, with ADDED: the cluster, the squared distance, its sum over the cluster and over all vectors, and the
    digest of the centroid's components."""
    rows, centroids = delta_lloyd(df, id_col, vector, k, rounds, seed, dims, scale)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    table = df.sparkSession.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), d) for i, d in digests], "__c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    own = [F.col("__row")[c].alias(c) for c in df.columns if c not in ADDED]
    return rows.join(F.broadcast(table), F.col("cluster") == F.col("__c")).select(*own, *ADDED)  # k rows


def centroid_table(df: DataFrame, **options) -> DataFrame:
    """(cluster, centroid): the final centroids."""
    _, centroids = delta_lloyd(df, **options)
    return df.sparkSession.createDataFrame(list(enumerate(centroids)), StructType().add("cluster", IntegerType()).add("centroid", ArrayType(LongType())))
