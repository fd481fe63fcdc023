"""Exact dedup and SimHash against brute force, with hostile rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __file2 string, fp int, digest string"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
ROWS = [
    (1, "a  b\tc", None, None, None, "x", 1, "q"),
    (2, "a b c", "en", "s", 5, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", None, "", 0, None, None, None),
    (4, "", None, "", 0, None, None, None),
    (None, "a b c", None, None, None, None, None, None),
    (5, LONG, None, None, None, None, None, None),
    (6, LONG + " tail", None, None, None, None, None, None),
    (7, " ", None, None, None, None, None, None),
    (8, "A B C", None, None, None, None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_exact_dedup_hostile_rows(spark):
    got = sorted((tuple(r) for r in exact_dedup.dedup(frame(spark, ROWS)).collect()), key=str)
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        low, seen = min(i for i in ids if i is not None), False
        for i in ids:
            kept = i == low and not seen
            seen |= kept
            want.append((i, low, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.dedup(frame(spark, [])).count() == 0
    assert exact_dedup.keep_first(frame(spark, ROWS)).count() == len(groups)


def test_exact_dedup_index_remembers(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.dedup(frame(spark, ROWS[:2]), index).collect()
    again = {r.doc_id: r for r in exact_dedup.dedup(frame(spark, [ROWS[1], ROWS[9]]), index).collect()}
    assert (again[2].keep_id, again[2].kept, again[8].kept) == (1, False, True)
    assert index.table().count() == 2
    same_place = exact_dedup.DigestIndex(spark, index.path)
    assert same_place.table().count() == 2


@given(st.text(alphabet="aBÄ \n\t.", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint_is_the_contract(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_every_pair_in_the_radius_shares_a_mask():
    rng = random.Random(1)
    masks = simhash.covering_masks((1 << 64) - 1)
    assert len(masks) == 31
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_components_against_brute_force(spark):
    got = sorted((tuple(r) for r in simhash.components(frame(spark, ROWS)).collect()), key=str)
    fps = [brute_fp(r[1]) for r in ROWS]
    roots = brute_components(fps)
    low = {}
    for r, c in zip(ROWS, roots, strict=True):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", low[c]) for r, f, c in zip(ROWS, fps, roots, strict=True)), key=str)
    assert got == want
    assert simhash.components(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, ROWS)).count() == len(set(roots))


@pytest.mark.parametrize("largest", [simhash.MAX_BUCKET, 100])
def test_links_of_crowded_fingerprints(spark, monkeypatch, largest):
    """Many fingerprints within a few bits, so that buckets are masked again; components must be exact."""
    monkeypatch.setattr(simhash, "MAX_BUCKET", largest)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = set()
    for b in base:
        for _ in range(130):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash._bucket_edges(4)
    import pyarrow as pa

    todo, found = [(0, signed)], []
    while todo:
        rows = []
        for fixed, group in todo:
            for m in simhash.covering_masks(~fixed & ((1 << 64) - 1)):
                m = simhash._signed(m) | fixed
                rows += [(m, x & m, x) for x in group]
        rows.sort()
        todo = defaultdict(set)
        batches = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 37], strict=True)], ["fixed", "k", "fp"]) for i in range(0, len(rows), 37))
        rows_out = [r for b in edges(batches) for r in b.to_pylist()]
        for r in rows_out:
            if r["b"] is not None:
                found.append((r["a"], r["b"]))
            else:
                todo[r["fixed"]].add(r["a"])
        todo = [(k, sorted(v)) for k, v in todo.items()]
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    mine, theirs = [find(x) for x in signed], brute_components(fps)
    assert len(set(mine)) == len(set(theirs)) == len(set(zip(mine, theirs, strict=True)))


@pytest.mark.parametrize(("bits", "largest"), [(12, 100), (12, simhash.MAX_BUCKET), (15, simhash.MAX_BUCKET)])
def test_dense_buckets_end(spark, monkeypatch, bits, largest):
    """All fingerprints over a few bits: one component, and another far away."""
    monkeypatch.setattr(simhash, "MAX_BUCKET", largest)
    far = 1 << 62 | 0b1010101 << 40
    fps = spark.range(1 << bits).select("id").union(spark.range(far, far + 4)).toDF("fp")
    edges = [(r.a, r.b) for r in simhash.linked(fps).collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root.setdefault(root[x], root[x])
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    assert len({find(x) for x in range(1 << bits)}) == 1
    assert len({find(far + i) for i in range(4)}) == 1
    assert find(0) != find(far)


CLASHES = ("file", "row", "doc", "v", "k", "c", "best", "digest", "group_size", "is_new", "__file", "__row", "_metadata", "fp", "bands")


@pytest.mark.parametrize("stored", [False, True])
def test_extra_columns_of_any_name(spark, tmp_path, stored):
    from ledgerloom.llm import near_copies

    docs = frame(spark, ROWS).select("doc_id", "text", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(CLASHES)])
    if stored:
        docs.repartition(2).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    assert exact_dedup.dedup(docs).count() == len(ROWS)
    for keep, count in ((exact_dedup.keep_first, 6), (simhash.keep_one, 3), (near_copies.keep_one, 3)):
        kept = keep(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert len(rows) == count
        assert all(r["_metadata"] == f"x{CLASHES.index('_metadata')}" and r["row"] == "x1" for r in rows)


def test_a_batch_added_again_keeps_the_same_rows(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = sorted(tuple(r) for r in exact_dedup.dedup(frame(spark, ROWS[:3]), index, "monday").collect())
    again = sorted(tuple(r) for r in exact_dedup.dedup(frame(spark, ROWS[:3]), index, "monday").collect())
    assert first == again and index.table().count() == 2
    other = exact_dedup.dedup(frame(spark, [ROWS[1], ROWS[9]]), index, "tuesday").collect()
    assert sorted((r.doc_id, r.kept) for r in other) == [(2, False), (8, True)]
    small = index.compact()
    assert sorted(map(tuple, small.table().collect())) == sorted(map(tuple, index.table().collect()))
    assert len(small.table().inputFiles()) <= 4
    again = sorted(tuple(r) for r in exact_dedup.dedup(frame(spark, ROWS[:3]), small, "monday").collect())
    assert first == again
