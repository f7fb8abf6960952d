"""Exact integer k-means whose assignments look up a pivot table, after LAESA.

A few vectors are fixed as pivots, and every vector's distances to them are stored once, beside the vector. In each round the
centroids' distances to the same pivots are computed, a small table. By the triangle inequality |d(x, p) - d(c, p)| <= d(x, c), so
the largest such difference over the pivots is a lower bound for every centroid without touching the vector. A vector is first
compared with the centroid of the least bound; of the others only those whose bound does not exceed the distance found are
compared, exactly, in integers. Bounds are floating-point and get a margin, so rounding never rules out a nearest centroid.

What the driver holds are the centroids and the pivots, k + n_pivots vectors whatever the table's size. Sums of a cluster are made
per batch, then by Spark; a cluster with most of the vectors is no bottleneck.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: Components beyond this, after scaling, could overflow a long in a squared distance of a few hundred of them.
LARGEST = 1 << 26
#: Relative and absolute margin of the bounds.
MARGIN, SLACK = 1e-9, 1e-6


def integer_vectors(vectors: DataFrame, dimensions: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, x): the rows whose embedding has exactly `dimensions` components, none null or non-finite, as floor(scale * component).

    A component beyond LARGEST after scaling raises an error, since exact distances might not fit a long.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.filter(e.isNotNull() & (F.size(e) == dimensions) & ~bad)
    large = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))
    whole = F.transform(e, lambda c: F.when(F.abs(c.cast("double") * scale) > LARGEST, large.cast("int")).otherwise(F.floor(c.cast("double") * scale).cast("int")))
    return kept.select("vec_id", whole.alias("x"))


def _least_hashed(rows: DataFrame, salt: str, n: int) -> list[list[int]]:
    """x of the n rows with the least SHA-256 of salt:vec_id, in that order; ties by x, rows without an id last."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r.x for r in rows.select(name.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(n).collect()]


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Of the sample, n pivots one after the other: each the one with the largest sum of distances to those taken."""
    taken = [0] if len(sample) else []
    total = np.zeros(len(sample))
    while len(taken) < min(n, len(sample)):
        total += np.sqrt(_squares(sample, sample[taken[-1]][None])[:, 0])
        total[taken] = -1
        taken.append(int(total.argmax()))
    return sample[taken]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.int64)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of y."""
    out = np.empty((len(x), len(y)), np.int64)
    for j, row in enumerate(y):
        gap = x - row
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, x, d): 32-bit components and 64-bit distances to the pivots, as bytes. Written once, read in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().astype(np.int32).reshape(batch.num_rows, -1)
            d = np.sqrt(_squares(x.astype(np.int64), pivots).astype(np.float64))
            parts = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (x, d)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], names=["vec_id", "x", "d"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"vec_id {kind}, x binary, d binary"))


def nearest_centroid(x: np.ndarray, d: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid of each row of x, ties to the smaller number, and how many exact
    distances that took. d has the rows' distances to the pivots, to_pivots those of the centroids."""
    bound = np.zeros((len(x), len(centroids)))
    for j, c in enumerate(to_pivots):
        bound[:, j] = np.abs(d - c).max(axis=1, initial=0)
    bound = bound * (1 - MARGIN) - SLACK
    first = bound.argmin(axis=1)
    gap = x - centroids[first]
    best, number = np.einsum("ij,ij->i", gap, gap), first.copy()
    compared = len(x)
    for j in range(len(centroids)):
        left = np.flatnonzero((first != j) & (bound[:, j] <= np.sqrt(best)))
        gap = x[left] - centroids[j]
        exact = np.einsum("ij,ij->i", gap, gap)
        better = (exact < best[left]) | ((exact == best[left]) & (j < number[left]))
        best[left[better]], number[left[better]] = exact[better], j
        compared += len(left)
    return number, best, compared


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, keep_ids: bool) -> DataFrame:
    """Per vector (vec_id, cluster, distance); or, if not keep_ids, sums per batch and cluster (cluster, n, total)."""
    to_pivots = np.sqrt(_squares(centroids, pivots).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            d = np.frombuffer(b"".join(batch.column("d").to_pylist()), np.float64).reshape(len(x), len(pivots))
            number, distance, _ = nearest_centroid(x, d, centroids, to_pivots)
            if keep_ids:
                columns = [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])
                continue
            found = np.unique(number)
            totals = [x[number == j].sum(axis=0).tolist() for j in found]
            sizes = [int((number == j).sum()) for j in found]
            columns = [pa.array(found.astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(totals, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    if keep_ids:
        kind = table.schema["vec_id"].dataType.simpleString()
        return table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    return table.select("x", "d").mapInArrow(run, "cluster int, n long, total array<long>")


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the componentwise floor of the mean of its vectors; one without vectors stays."""
    parts = _assigned(table, centroids, pivots, keep_ids=False)
    sizes = parts.select("cluster", "n", F.posexplode("total").alias("place", "part"))
    exact = "decimal(38,0)"
    sums = sizes.groupBy("cluster", "place").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("part").cast(exact)).alias("total"))
    out = centroids.copy()
    for row in sums.collect():  # one row a centroid and component
        out[row.cluster, row.place] = int(row.total) // int(row.n)
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, n_pivots: int = 16, sample: int = 512
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector of `dimensions` finite components.

    vectors needs vec_id and embedding (an array of numbers); other columns are ignored. Vectors that are null, of another length,
    or hold null or non-finite components take no part. Components become floor(scale * component). The k vectors with the least
    SHA-256 of 1:vec_id are the first centroids (all vectors, if fewer); rows with the same id are taken one after the other by
    their components, and rows without an id come last. Every row counts, repeated ones too. Pivots are taken from `sample`
    vectors of another hash order; they only decide how much is compared. An empty table gives no rows.
    """
    rows = integer_vectors(vectors, dimensions, scale)
    centroids = np.array(_least_hashed(rows, "1", k), np.int64).reshape(-1, dimensions)
    pivots = _far_apart(np.array(_least_hashed(rows, "pivot", sample), np.int64).reshape(-1, dimensions), n_pivots)
    table = pivot_table(rows, pivots)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(table, centroids, pivots)
    if not len(centroids):
        assigned = table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        assigned = stored(_assigned(table, centroids, pivots, keep_ids=True))
    inertia = dict(map(tuple, assigned.groupBy("cluster").agg(F.sum("distance")).collect()))  # at most k rows
    named = [
        (j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for j, c in enumerate(centroids)
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(vectors.sparkSession.createDataFrame(named, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
