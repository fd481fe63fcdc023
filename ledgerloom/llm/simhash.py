"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of distinct texts are masked with 2^(r+1) - 1 structured bit masks: bit i carries a vector m(i) of r + 1
bits, and mask v keeps the bits whose vector has odd overlap with v. Any r differing bits leave some v orthogonal to all
of them, so every pair within the radius agrees on some mask: no link is lost. A masked bucket with more than
MAX_BUCKET fingerprints is masked again over the bits it leaves free, of which every mask then fixes at least one; with
FEW_BITS or fewer free bits it is compared as it is, since it cannot hold more than 2^FEW_BITS fingerprints. So no task
holds an unbounded group, and the rounds end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_materialized, fresh, lookup, materialize, rows_without, with_row_key

SHINGLE, RADIUS, BITS = 4, 4, 64
MAX_BUCKET = 2048
#: Free bits up to which a bucket is compared whole: 32768 fingerprints at most.
FEW_BITS = 15
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: words of ASCII-lower-cased text, shingles with repeats, XXH64 with seed 42, bit majority."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """keys and fp (the fingerprint's 64 bits as a long) of every row; null text counts as empty."""

    def each(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*keys, "fp"])

    picked = fresh(docs, *keys, "text")
    schema = picked.select(*keys, F.lit(0).cast("long").alias("fp")).schema
    return picked.mapInArrow(each, schema)


@lru_cache(None)
def covering_masks(free: int, radius: int = RADIUS) -> tuple[int, ...]:
    """Masks over the set bits of `free` such that any `radius` of them are all left out by some mask.

    Bits take the unit vectors first, so that every mask keeps some bit if there are more than `radius`.
    """
    bits = [i for i in range(BITS) if free >> i & 1]
    units = [1 << j for j in range(radius + 1)]
    vectors = units + [x for x in range(1, 1 << (radius + 1)) if x not in units]
    return tuple(sum(1 << i for k, i in enumerate(bits) if (vectors[k % len(vectors)] & v).bit_count() % 2) for v in range(1, len(vectors) + 1))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Star edges (root, member) of the components of fps under the radius."""
    todo, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not todo[i]:
            continue
        todo[i], queue = False, [i]
        while queue:
            j = queue.pop()
            near = np.flatnonzero(todo & (np.bitwise_count(fps ^ fps[j]) <= radius))
            todo[near] = False
            out += [(i, int(x)) for x in near]
            queue += near.tolist()
    return out


def _bucket_edges(radius: int):
    """Rows (fixed, k, fp), sorted by bucket, to edges (a, b) or, from buckets that are too large, rows to mask again."""

    def too_large(fixed, size):
        return size > MAX_BUCKET and BITS - (fixed & ((1 << BITS) - 1)).bit_count() > max(FEW_BITS, radius)

    def flush(fps, fixed, key, edges, over):
        if too_large(fixed, len(fps)):
            over.append((fixed, key, fps))
        elif len(fps) > 1:
            u = fps.view(np.uint64)
            if len(fps) == 2:
                if int(u[0] ^ u[1]).bit_count() <= radius:
                    edges.append((int(fps[0]), int(fps[1])))
            else:
                edges.extend((int(fps[i]), int(fps[j])) for i, j in _forest(u, radius))

    def batch_of(edges, over):
        a = [x for x, _ in edges] + [int(f) for _, _, fs in over for f in fs]
        b = [y for _, y in edges] + [None] * (len(a) - len(edges))
        fixed = [None] * len(edges) + [x for x, _, fs in over for _ in fs]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fixed, pa.int64())], ["a", "b", "fixed"])

    def each(batches):
        held, at, spilling = np.empty(0, np.int64), None, False
        for batch in batches:
            fixed, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            if not len(fp):
                continue
            edges, over = [], []
            cuts = np.flatnonzero((fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            multi = np.flatnonzero(ends - starts > 1)
            first, last = 0, len(starts) - 1
            for g in sorted({first, last, *multi.tolist()}):
                s, e = starts[g], ends[g]
                group, mine = (int(fixed[s]), int(key[s])), fp[s:e]
                if g == first and at is not None:
                    if group == at:
                        mine = np.concatenate((held, mine))
                    else:
                        if not spilling:
                            flush(held, *at, edges, over)
                        spilling = False
                if g == last:
                    at, held = group, mine
                    if spilling or too_large(group[0], len(held)):
                        over.append((*group, held))
                        held, spilling = np.empty(0, np.int64), True
                elif spilling and g == first and group == at:
                    over.append((*group, mine))
                    spilling = False
                else:
                    flush(mine, *group, edges, over)
            if edges or over:
                yield batch_of(edges, over)
        if at is not None and not spilling:
            edges, over = [], []
            flush(held, *at, edges, over)
            if edges or over:
                yield batch_of(edges, over)

    return each


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly what links at `radius` or fewer differing bits connect. distinct: distinct fp."""
    rows, out = distinct.select(F.lit(0).cast("long").alias("fixed"), "fp"), None
    while True:

        def masked(batches, radius=radius):
            for batch in batches:
                fixed, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for f in np.unique(fixed):
                    mine = fp[fixed == f]
                    for added in covering_masks(~int(f) & ((1 << BITS) - 1), radius):
                        if not added:
                            raise ValueError("a bucket that no mask divides")
                        mask = _signed(added) | int(f)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), mask, np.int64)), pa.array(mine & np.int64(mask)), pa.array(mine)], ["fixed", "k", "fp"])

        keyed = rows.mapInArrow(masked, "fixed long, k long, fp long")
        found = materialize(keyed.repartition("fixed", "k").sortWithinPartitions("fixed", "k").mapInArrow(_bucket_edges(radius), "a long, b long, fixed long"), "buckets")
        edges = found.where("b is not null").select("a", "b")
        out = edges if out is None else out.union(edges)
        rows = found.where("fixed is not null").select("fixed", F.col("a").alias("fp")).distinct()
        if found.where("fixed is not null").isEmpty():
            return out


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id, n): of each distinct fingerprint, its component's smallest doc_id and its own row count."""
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "fps")
    parts = connected_components(linked(groups.select("fp"), radius))
    labelled = groups.join(parts, groups.fp == parts.v, "left").select("fp", "low", "n", F.coalesce("c", "fp").alias("c"))
    labelled = materialize(labelled, "labels")
    least = labelled.groupBy("c").agg(F.min("low").alias("component_id"), F.sum("n").alias("size"))
    drop_materialized(groups)
    return labelled.join(least, "c").select("fp", "component_id", "n", "c")


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and blank texts have fingerprint zero and link like any other; texts of any length are read whole; repeated rows
    come out as often as they came in; rows with a null doc_id are kept and do not lend their id to a component; a bit that
    exactly half of the hashes have is 0; an empty table gives an empty result; extra columns of any name are left out.
    """
    fps = materialize(fingerprints(docs, ("doc_id",), shingle), "docs")
    out = lookup(fps, classes(fps, radius), "fp", "n", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component left: that with the smallest doc_id (of several, the first as stored).

    Nulls, empty and long texts and empty tables as in components; every column of docs stays, whatever its name.
    """
    keyed = with_row_key(docs)
    fps = materialize(fingerprints(keyed.select("doc.doc_id", "file", "row", "doc.text"), ("doc_id", "file", "row"), shingle), "docs")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("best")
    firsts = fps.groupBy("fp").agg(best)  # pre-aggregated, so that a hot fingerprint costs one row a task
    kept = firsts.join(classes(fps, radius).select("fp", "c"), "fp").groupBy("c").agg(F.min("best").alias("best")).select("best.file", "best.row")
    return rows_without(keyed, fps.select("file", "row").join(kept, ["file", "row"], "left_anti")).select("doc.*")
