"""Centroid clustering in whole numbers: rounds of nearest centroids and exact means, fast where float64 is exact.

Vectors become whole numbers, and squared distances are taken as |x|^2 - 2 x.c + |c|^2, blocks of rows at a time, by the
matrix product of float64. That is exact as long as everything in it stays below 2^53, which a bound on the magnitudes of
both sides proves before the product; rows or centroids beyond the bound are compared in whole numbers instead. Each Arrow
batch gives one row of sums, counts and inertia, and RDD.treeAggregate adds these in Python's whole numbers, so the driver
sees a number for each centroid and component, however many rows there are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed by the contract: components of a vector, their scale, the seed of the first centroids, their number, the rounds.
SIZE, SCALE, SEED, CENTROIDS, ROUNDS = 64, 256, 2, 40, 5
#: Rows of a block of the matrix product.
BLOCK = 4096
LONG = (1 << 63) - 1


def limit(size: int, bits: int) -> int:
    """The magnitude up to which squared distances of `size` components, and all they are made of, stay below 2^bits."""
    return math.isqrt(((1 << bits) - 1) // (4 * size))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite float64 numbers: float64 where that holds it, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    return out if np.isfinite(out).all() else np.array([[math.floor(v * SCALE) if abs(v) < 1 else math.floor(v) * SCALE + math.floor((v - math.floor(v)) * SCALE) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's own."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all centroids (of Python's whole numbers): long if they fit, else Python's."""
    size, far = x.shape[1], np.abs(c).max(axis=1).astype(object)
    high = np.abs(x).max(axis=1)
    near_rows, near = high <= limit(size, 53), np.array([v <= limit(size, 53) for v in far], bool)
    if near_rows.all() and near.all():
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), object)
    if near_rows.any() and near.any():
        out[np.ix_(near_rows, near)] = distances(x[near_rows], c[near]).astype(object)
    for rows, cols in ((near_rows, ~near), (~near_rows, np.ones(len(c), bool))):
        if not rows.any() or not cols.any():
            continue
        longs = max([int(high[rows].max()), *far[cols]]) <= limit(size, 62)
        a, b = (x[rows].astype(np.int64), c[cols].astype(np.int64)) if longs else (_exact(x[rows]), c[cols])
        for k, centre in zip(np.flatnonzero(cols).tolist(), b, strict=True):
            out[np.flatnonzero(rows), k] = ((a - centre) ** 2).sum(axis=1).astype(object)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smaller number of equally near ones) and its squared distance."""
    d = distances(x, c)
    at = d.argmin(axis=1) if len(c) else np.zeros(0, np.int64)
    return at, d[np.arange(len(x)), at]


def sums(x: np.ndarray, at: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Python's whole numbers by centroid: the sum of each component, the number of rows, the sum of distances."""
    out = np.zeros((k, x.shape[1] + 2), object)
    if x.dtype != object and float(np.abs(x).max(initial=0)) * len(x) < 1 << 53:
        ones = np.zeros((k, len(x)))
        ones[at, np.arange(len(x))] = 1
        out[:, :-2] = (ones @ x).astype(np.int64).astype(object)
    else:
        np.add.at(out, (at, slice(0, -2)), _exact(x))
    out[:, -2] = np.bincount(at, minlength=k).astype(object)
    np.add.at(out[:, -1], at, d.astype(object))
    return out


def _packed(numbers: np.ndarray) -> str:
    return ",".join(map(str, numbers.ravel().tolist()))


def _unpacked(text: str, k: int) -> np.ndarray:
    return np.array([int(v) for v in text.split(",")], object).reshape(k, -1)


def _blocks(batches):
    """Of each batch (vec_id, vector) blocks: where they start, and their whole numbers."""
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        yield batch, [(i, whole(x[i : i + BLOCK])) for i in range(0, len(x), BLOCK)]


def _totals(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """sums over all vectors: a row for each Arrow batch, added up in a tree."""
    held, k = vectors.sparkSession.sparkContext.broadcast(centroids), len(centroids)  # numbers of k centroids

    def each(batches):
        for _, blocks in _blocks(batches):
            total = sum(sums(x, *nearest(x, held.value), k) for _, x in blocks)
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(total)])], ["sums"])

    rows = vectors.mapInArrow(each, "sums string").rdd
    depth = max(2, math.ceil(math.log(max(2, rows.getNumPartitions()), 64)))
    out = rows.treeAggregate(0, lambda a, r: a + _unpacked(r.sums, k), lambda a, b: a + b, depth)
    held.destroy()
    return out if isinstance(out, np.ndarray) else np.zeros((k, centroids.shape[1] + 2), object)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and id; of equal ids, by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").orderBy(digest, "vector").limit(k).collect()  # k rows
    return _exact(whole(np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1))) if rows else np.zeros((0, SIZE), object)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector (column embedding) that is kept.

    Kept are vectors of `size` components, none of them null or not finite; the others (null and empty ones too) have no
    row. Fewer kept vectors than k give as many centroids; of equal centroids the smallest number takes all, the others stay
    empty and as they were. Rows with a null id are clustered but begin no cluster; repeated rows count each. If no kept
    vector has an id, or the table is empty, the result is empty. Numbers beyond the range of a long are null in the result,
    while clusters and centroids stay exact. Extra columns of any name are left out. Every round reads the vectors once;
    what leaves a task is a row of k * (size + 2) numbers for each batch.
    """
    fit = (F.size("embedding") == size) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = materialize(vectors.select("vec_id", F.col("embedding").alias("vector")).where(fit), "vectors")
    centres = first_centroids(kept, k, seed)
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    names = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
    schema = kept.select("vec_id", *[null(t, c) for c, t in names.items()]).schema
    if not len(centres):
        return kept.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        total = _totals(kept, centres)
        full = total[:, -2] > 0
        centres[full] = total[full, :-2] // total[full, -2:-1]
    inertia = _totals(kept, centres)[:, -1]
    told = lambda v: v if v <= LONG else None
    by = [(told(v), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for v, c in zip(inertia.tolist(), centres.tolist(), strict=True)]
    held = kept.sparkSession.sparkContext.broadcast((centres, by, told(sum(inertia.tolist()))))

    def each(batches):
        ends, own, whole_inertia = held.value
        for batch, blocks in _blocks(batches):
            pairs = [nearest(x, ends) for _, x in blocks]
            at = np.concatenate([a for a, _ in pairs]) if pairs else np.zeros(0, np.int64)
            far = [v if v <= LONG else None for _, d in pairs for v in d.tolist()]
            taken = pa.array(at)
            columns = [pa.array(at.astype(np.int32)), pa.array(far, pa.int64()), pa.array([v for v, _ in own], pa.int64()).take(taken), pa.array([whole_inertia] * len(at), pa.int64()), pa.array([h for _, h in own], pa.string()).take(taken)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["vec_id", *names])

    return kept.mapInArrow(each, schema)
