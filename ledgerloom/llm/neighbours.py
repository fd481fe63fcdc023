"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector is rotated and only the signs of its components are kept, packed into bits, with one correction scalar (the
inner product of the vector with its code). The inner product with a query, quantised to a few bits, is estimated from
popcounts; its error bound decides which vectors are scored again on the original data, in the same pass: with the exact
score of the k-th best so far as floor, a tenth of the vectors is scored again at 64 components. (Bounds alone, over codes
without the vectors, would leave half of them.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, unique_name

#: Bytes of query vectors that are held by every task at once; more are searched block after block.
QUERY_BYTES = 16 << 20
#: Bits of a quantised query component, and deviations of the estimate that the error bound spans.
QUERY_BITS, DEVIATIONS = 4, 2.5
_ROWS, _QUERIES = 4096, 256


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view("<u8")


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors and their correction scalars."""
    turned = unit @ rotation(unit.shape[1]).T
    return _words(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


class QueryCodes:
    """Queries rotated and quantised to QUERY_BITS bits a component, as bit planes."""

    def __init__(self, unit: np.ndarray):
        dim = unit.shape[1]
        turned = unit @ rotation(dim).T
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-12)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [_words(levels >> b & 1) for b in range(QUERY_BITS)]
        self.total, self.dim = levels.sum(axis=1, dtype=np.int64), dim
        self.slack = self.step * math.sqrt(dim) / 2  # of the quantisation, at most

    def estimate(self, q: slice, codes: np.ndarray, fix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of queries q with coded vectors, and how far the true ones may be above."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        dot = sum((np.bitwise_count(p[q][:, None, :] & codes[None]).sum(axis=2, dtype=np.int32) << b) for b, p in enumerate(self.planes))
        signed = (2 * dot - self.total[q][:, None]) * self.step[q][:, None] + self.low[q][:, None] * (2 * ones - self.dim)[None]
        bound = DEVIATIONS * np.sqrt(np.maximum(1 - fix**2, 0)) / fix / math.sqrt(max(1, self.dim - 1))
        return signed / math.sqrt(self.dim) / fix[None], bound[None] + (self.slack[q][:, None] / math.sqrt(self.dim) / fix[None]) * 0.5


def _usable(df: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of vectors that aren't null, empty or zero and hold only finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in column]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def exact_cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, row by row, so that equal vectors score alike wherever they stand.

    Components that would overflow or vanish when squared are scaled first.
    """
    m = np.abs(rows).max(axis=1, keepdims=True)
    rows = np.where((m > 1e-100) & (m < 1e100), rows, rows / m)
    q = q if 1e-100 < (x := np.abs(q).max()) < 1e100 else q / x
    dot = np.einsum("ij,j->i", rows, q)
    return dot / (np.sqrt(np.einsum("j,j->", q, q)) * np.sqrt(np.einsum("ij,ij->i", rows, rows)))


class _Best:
    """The k nearest of each query so far: scores descending, ids ascending on ties."""

    def __init__(self, queries: int, k: int):
        self.scores, self.ids, self.k = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max), k

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate((self.scores[i], scores)), np.concatenate((self.ids[i], ids))
        order = np.lexsort((d, -s))
        order = order[s[order] > -np.inf]
        order = order[np.sort(np.unique(d[order], return_index=True)[1])][: self.k]  # an id counts once
        self.scores[i, : len(order)], self.ids[i, : len(order)] = s[order], d[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query row, other rows than its own (by vec_id).

    Unusable vectors (null, empty, zero, or with null or non-finite components) take no part on either side; vectors of
    another length than a query's aren't compared with it. Rows with equal ids count once (the first of equal scores).
    Ties go to the smaller vec_id; with fewer candidates than k, all are returned; an empty table on either side gives an
    empty result; extra columns of any name are left out. Every row is coded and compared; the queries are taken in blocks
    of QUERY_BYTES (or `block` rows), each held by all tasks while they pass over the vectors, and each block's ranks are
    appended to one table, so neither plan nor intermediates grow with the number of blocks.
    """
    spark, base = vectors.sparkSession, _usable(vectors)
    asked = materialize(_usable(queries).dropDuplicates(["vec_id"]), "queries")
    count, floats = asked.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    blocks = max(1, math.ceil(count / block if block else 8 * (floats or 0) / QUERY_BYTES))
    path = f"{shared_dir(spark)}/ledgerloom/{unique_name('nearest')}"
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b  # about a block, whatever the partitions
        rows = asked.where(mine).select("vec_id", "v").toArrow()
        ids, units = rows.column(0).to_numpy(), [v for c in rows.column(1).chunks for v in _matrix(c)]
        groups = {d: [i for i, v in enumerate(units) if len(v) == d] for d in {len(v) for v in units}}
        held = spark.sparkContext.broadcast({d: (ids[at].astype(np.int64), np.stack([units[i] for i in at])) for d, at in groups.items()})

        def each(batches: Iterator[pa.RecordBatch], held=held):
            sides = {d: (ids, raw, QueryCodes(_unit(raw)), _Best(len(ids), k)) for d, (ids, raw) in held.value.items()}
            for batch in batches:
                all_ids, rows = np.asarray(batch.column(0)), _matrix(batch.column(1))
                lengths = np.array([len(r) for r in rows])
                for d in set(lengths.tolist()) & sides.keys():
                    mine = np.flatnonzero(lengths == d)
                    q_ids, q_raw, codes, best = sides[d]
                    for lo in range(0, len(mine), _ROWS):
                        pick = mine[lo : lo + _ROWS]
                        raw, ids = np.stack([rows[i] for i in pick]), all_ids[pick]
                        packed, fix = encode(_unit(raw))
                        for q in range(0, len(q_ids), _QUERIES):
                            part = slice(q, q + _QUERIES)
                            guess, above = codes.estimate(part, packed, fix)
                            for i, (g, a) in enumerate(zip(guess, np.broadcast_to(above, guess.shape), strict=True), q):
                                floor = best.scores[i, -1]
                                if floor == -np.inf:  # first the likeliest, for a floor
                                    top = np.argpartition(-g, min(4 * k, len(g) - 1))[: 4 * k]
                                    top = top[ids[top] != q_ids[i]]
                                    if len(top) >= k:
                                        floor = np.sort(exact_cosines(q_raw[i], raw[top]))[-k]
                                near = np.flatnonzero((g + a >= floor) & (ids != q_ids[i]))
                                if len(near):
                                    best.add(i, exact_cosines(q_raw[i], raw[near]), ids[near])
            for q_ids, _, _, best in sides.values():
                at = np.argwhere(best.scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[:, 0]]), pa.array(best.ids[at[:, 0], at[:, 1]]), pa.array(best.scores[at[:, 0], at[:, 1]])], ["query_id", "vec_id", "score"])

        found = base.mapInArrow(each, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked.write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(path)
