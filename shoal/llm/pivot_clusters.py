"""Centroid clustering of integer vectors with exact assignments, by a table of distances to fixed pivots.

Each vector's distances to a few pivots are computed once and stored beside it. By the triangle inequality, the
difference of a vector's and a centroid's distance to a pivot is at most the distance between the two; in each round
the largest of these differences bounds every centroid from below, and only those that may still be nearest get an
exact distance in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import saved, ship

#: Components are floor(SCALE * x). Within ±2^27 the squared distance of 64 components fits a long.
SCALE, WIDEST = 64, 1 << 27
#: Pivots, taken from the first centroids as far apart as they are.
PIVOTS = 8
#: Rows that a task compares with all centroids at a time.
BLOCK = 4096


def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one vector."""
    d = rows - to
    return np.einsum("ij,ij->i", d, d)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each the farthest from those before; the first is the first."""
    picked, near = [0], squared(vectors, vectors[0])
    while len(picked) < min(n, len(vectors)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, squared(vectors, vectors[picked[-1]]))
    return vectors[picked]


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(rows, p) for p in pivots], axis=1).astype(np.float64))


def nearest(rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid (ties: the smaller number), the squared distance, and how many exact distances that took.

    ``table`` holds the rows' distances to the pivots, ``to_pivots`` the centroids'. They are rounded, so bounds are
    taken less by more than rounding can add.
    """
    least = np.zeros((len(rows), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(least, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=least)
    least -= 1e-12 * (table.max(axis=1)[:, None] + to_pivots.max(axis=1)[None, :])
    first = least.argmin(axis=1)
    best = np.empty(len(rows), np.int64)
    for c in np.unique(first):
        at = np.flatnonzero(first == c)
        best[at] = squared(rows[at], centroids[c])
    which, exact = first.copy(), len(rows)
    for c in range(len(centroids)):
        at = np.flatnonzero((first != c) & (least[:, c] <= np.sqrt(best.astype(np.float64)) * (1 + 1e-12)))
        d = squared(rows[at], centroids[c])
        exact += len(at)
        won = (d < best[at]) | (d == best[at]) & (c < which[at])
        best[at[won]], which[at[won]] = d[won], c
    return which, best, exact


def blocks(batches: Iterator[pa.RecordBatch], n_pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            b = whole.slice(start, BLOCK)
            rows = np.frombuffer(b"".join(b["vector"].to_pylist()), "<i8").reshape(b.num_rows, -1)
            yield b, rows, b["to_pivots"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_pivots)


def kept_vectors(df: DataFrame, vec_id: str, embedding: str, size: int) -> DataFrame:
    """vec_id, vector: rows of exactly ``size`` finite components, as integers. A component that leaves ±2^27 is an error,
    as its squared distances may not fit the result's type."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = df.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where((F.size("x") == size) & F.forall("x", finite))
    whole = F.transform("x", lambda v: F.floor(v * SCALE))
    fits = F.forall("x", lambda v: F.abs(v * SCALE) < WIDEST)
    return rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component leaves +-{WIDEST / SCALE:g}")).cast("array<bigint>")).alias("vector"))


def start_order(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def tabled(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pivot table: vec_id, vector as bytes, and its distances to the pivots, computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                rows = b["vector"].flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(b.num_rows, -1)
                d = pivot_distances(rows, pivots)
                yield pa.record_batch([b["vec_id"], pa.array([r.tobytes() for r in rows], pa.binary()), pa.FixedSizeListArray.from_arrays(d.ravel(), len(pivots)).cast(pa.list_(pa.float64()))], names=["vec_id", "vector", "to_pivots"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, vector binary, to_pivots array<double>")


def means(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a task sends one row of sums a cluster."""
    to_pivots = pivot_distances(centroids, pivots)
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, rows, d in blocks(batches, len(pivots)):
            which, _, _ = nearest(rows, d, centroids, to_pivots)
            n += np.bincount(which, minlength=len(centroids))
            for c in np.unique(which):
                sums[c] += rows[which == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], schema=schema)

    got = table.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    got = got.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = centroids.copy()
    for r in got.collect():  # one row a component of a centroid
        new[r.cluster, r.i] = int(r.s) // r.n
    return new


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared), n_exact: how many centroids got an exact distance, averaged over a block."""
    to_pivots = pivot_distances(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows, d in blocks(batches, len(pivots)):
            which, best, exact = nearest(rows, d, centroids, to_pivots)
            yield pa.record_batch([b["vec_id"], pa.array(which.astype(np.int32)), pa.array(best), pa.array(np.full(len(rows), exact / len(rows)))], names=["vec_id", "cluster", "distance", "n_exact"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, n_exact double")


def clusters(df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row whose embedding has exactly
    ``size`` components, none of them null or not finite; other rows are left out.

    The first centroids are the ``k`` kept rows of least sha256 of ``1:<vec_id>`` (a null id counts as an empty text, rows
    of one id go by their vectors); where fewer are kept, there are fewer. A centroid without vectors stays. Repeated
    rows and ids count as often as they are there; an empty table gives no rows; other columns aren't read.

    A round is one pass over the stored table without a shuffle of vectors. k x size numbers reach the driver a round.
    """
    spark = ship(df.sparkSession)
    vectors = kept_vectors(df, vec_id, embedding, size)
    first = vectors.orderBy(start_order(F.col("vec_id")), "vector").select("vector").limit(k).collect()
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.vector for r in first], np.int64)
    pivots = far_apart(centroids, n_pivots)
    table = saved(tabled(vectors, pivots), "pivot-table")
    for _ in range(rounds):
        centroids = means(table, centroids, pivots)
    got = saved(assigned(table, centroids, pivots), "clusters")
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    sums = got.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))).join(named, "cluster")  # k rows with one
    out = got.join(F.broadcast(sums), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
