"""Sharding against the law of a uniform shuffle, fill-in-middle and clustering against plain Python, with hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import centroids, fim, sharding

SCHEMA = "doc_id long, text string, shard int, slot int, file string, output string, form int, chunk string, `at` int, doc string"
LONG = "wörd  and\tmore " * 40_000
TEXTS = [None, "", " ", "a", "a", "two words ", "\n lead", "x <M> y", "<P", "日本 語 😀", LONG, "tab\tsep\x0bvt\x85nel", "a <S b S> c"]


def docs(spark, rows, files=3):
    return spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], SCHEMA).repartition(files)


def rows_of(copies=1):
    return [(i if i != 5 else None, t) for i, t in enumerate(TEXTS)] * copies


@pytest.mark.parametrize(("good", "bad", "sample"), [(5, 7, 6), (40, 3, 20), (3, 40, 40), (100, 200, 50), (1000, 1000, 1990)])
def test_large_hypergeometric_numbers_follow_the_law(good, bad, sample):
    n = 100_000
    got = Counter(sharding._drawn(np.random.default_rng(1), *(np.full(n, v) for v in (good, bad, sample))).tolist())
    low, high = max(0, sample - bad), min(good, sample)
    assert min(got) >= low and max(got) <= high
    law = {k: n * comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) for k in range(low, high + 1)}
    terms = [(got[k] - e) ** 2 / e for k, e in law.items() if e > 5]
    assert sum(terms) < len(terms) + 5 * math.sqrt(2 * len(terms)) + 5


def test_hypergeometric_numbers_of_a_trillion_rows():
    good, bad, sample, n = 300_000_000_000, 700_000_000_000, 200_000_000_000, 50_000
    got = sharding.hypergeometric(np.random.default_rng(2), *(np.full(n, v) for v in (good, bad, sample)))
    mean, var = sample * 0.3, sample * 0.3 * 0.7 * 0.8
    assert abs(got.mean() - mean) < 5 * math.sqrt(var / n) and abs(got.var() / var - 1) < 0.05
    edge = sharding.hypergeometric(np.random.default_rng(2), *(np.array(v) for v in ([0, good, good, 5], [good, 0, bad, good], [7, 9, good + bad, good + 5])))
    assert edge.tolist() == [0, 9, good, 5]


def test_matrix_rows_and_columns_are_exact():
    chunks = np.array([5, 0, 17, 1, 64, 3])
    m = sharding.Matrix(chunks, 4, 7, 11)
    dealt = [m.dealt(i) for i in range(len(chunks))]
    assert [len(x) for x in dealt] == chunks.tolist()
    assert (np.bincount(np.concatenate(dealt), minlength=len(m.size)) == m.size).all()
    shards = [int(m.size[m.shard == k].sum()) for k in range(4)]
    assert shards == [23, 23, 22, 22]


def test_every_way_to_deal_is_as_likely():
    """Four rows in two chunks, two shards of two: each of the 6 ways to choose shard 0 comes as often."""
    ways = Counter()
    for seed in range(6000):
        m = sharding.Matrix(np.array([3, 1]), 2, 8, seed)
        ways["".join(str(b) for c in range(2) for b in m.dealt(c).tolist())] += 1
    assert len(ways) == 6
    assert sum((n - 1000) ** 2 / 1000 for n in ways.values()) < 20


@pytest.mark.parametrize(("chunk", "block"), [(1 << 20, 1 << 14), (4, 3)])
def test_shards_hold_every_row_once(spark, chunk, block):
    rows = rows_of(5)
    made = sharding.sharded(docs(spark, rows), 8, 42, chunk, block).select("shard", "slot", "doc.doc_id", "doc.text").collect()
    assert Counter((r.doc_id, r.text) for r in made) == Counter(rows)
    by = {k: sorted(r.slot for r in made if r.shard == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.sharded(docs(spark, [])).count() == 0
    few = sharding.sharded(docs(spark, rows[:3], 1)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_slots_are_a_uniform_shuffle(spark, tmp_path):
    """Over many seeds each row comes to each of the six places as often."""
    spark.range(6).selectExpr("id doc_id", "'x' text").repartition(2).write.parquet(f"{tmp_path}/six")
    table, n, seen = spark.read.parquet(f"{tmp_path}/six"), 60, Counter()
    for seed in range(n):
        seen.update((r.doc.doc_id, r.shard, r.slot) for r in sharding.sharded(table, 2, seed, 2, 2).collect())
    assert len(seen) == 36
    assert sum((c - n / 6) ** 2 / (n / 6) for c in seen.values()) < 25 + 5 * math.sqrt(50)


def test_report_and_written_shards(spark, tmp_path):
    rows = rows_of(2)
    docs(spark, rows).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    out = sharding.report(table).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    assert sorted(map(str, out)) == sorted(map(str, sharding.report(table).collect()))
    plain = table.select("doc_id", "text")
    files = spark.read.parquet(sharding.write_shards(plain, f"{tmp_path}/out"))
    places = {(r.doc_id, r.text, r.shard, r.slot) for r in files.collect()}
    assert len(places) == len(rows) and files.where("shard = 3").count() in (3, 4)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@given(st.text(alphabet="ab \t\nßä日😀\x85\xa0", max_size=80), st.integers(1, 9), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_checkpoints_give_every_cut(text, step, window):
    units, points = UNIT.findall(text), fim.Checkpoints(text.encode(), step, window)
    assert points.n == len(units)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert points.cut(k) == (len(head.encode()), len(head))


def plain_fim(doc_id, text):
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, b = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    return (n, "spm", f"<S>{b}<P>{a}<M>{m}", len(a), len(m)) if h4 % 100 < 80 else (n, "psm", f"<P>{a}<S>{b}<M>{m}", len(a), len(m))


def test_fill_in_middle_against_plain_python(spark):
    rows = [(i, t) for t in TEXTS for i in (*range(20), None)]
    made = fim.transform(docs(spark, rows)).withColumn("back", fim.restored("output", "form")).collect()
    got = Counter((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back) for r in made)
    assert got == Counter((i, *plain_fim(i, t), t or "") for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.transform(docs(spark, [])).count() == 0
    everyone = fim.transform(docs(spark, [(7, "a b c")]), changed=100, spm=0).first()
    assert everyone.form == "psm"


def test_fill_in_middle_digests(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {r.doc_id: r for r in fim.report(docs(spark, list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        n, form, output, a, m = plain_fim(i, t)
        assert (out[i].n, out[i].form, out[i].prefix_chars, out[i].middle_chars, out[i].output_sha256, out[i].restored_sha256) == (n, form, a, m, sha(output), sha(t or ""))


def plain_clusters(rows, k=40, rounds=5, size=64):
    """vec_id, cluster, distance, cluster_inertia, inertia, digest by Python's whole numbers alone."""
    good = [(i, [math.floor(Fraction(float(v)) * 256) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    named = [r for r in good if r[0] is not None]
    cents = [x for _, x in sorted(named, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    if not cents:
        return []

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents)) for _, x in good]

    for _ in range(rounds):
        at = assigned()
        for j in range(len(cents)):
            own = [x for (_, x), (_, a) in zip(good, at, strict=True) if a == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assigned()
    by = Counter()
    for d, j in at:
        by[j] += d
    fit = lambda v: v if v < 1 << 63 else None
    return [(i, j, fit(d), fit(by[j]), fit(sum(by.values())), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(good, at, strict=True)]


VECTORS = "vec_id long, embedding array<double>, cluster string, distance int, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, None, None, None) for i, x in rows], VECTORS).repartition(3)


def agree(spark, rows, **kw):
    got = [tuple(r) for r in centroids.cluster(vectors(spark, rows), **kw).collect()]
    assert sorted(got, key=str) == sorted(plain_clusters(rows, **kw), key=str)


def test_clusters_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) + i % 7).tolist()) for i in range(300)]
    bad = [float("nan"), float("inf"), None]
    rows += [(900 + i, [*rows[0][1][:63], v]) for i, v in enumerate(bad)] + [(910, None), (911, []), (912, [1.0] * 63), (913, [1.0] * 65)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (3, rows[8][1]), (920, [-0.001] * 64)]
    agree(spark, rows)
    agree(spark, [])
    agree(spark, [(None, [1.0] * 64)])
    agree(spark, [(i, [1.0] * 64) for i in range(50)])  # equal centroids: the first takes all
    agree(spark, rows[:9])  # fewer than centroids


@pytest.mark.parametrize("scale", [1e4, 1e6, 1e12, 1e306])
def test_clusters_beyond_the_exact_floats(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=64) * (scale if i % 5 == 0 else 1)).tolist()) for i in range(60)]
    agree(spark, rows, k=6, rounds=3)


def test_exact_bound():
    assert 64 * (2 * centroids.limit(64, 53)) ** 2 < 1 << 53
    top = centroids.limit(64, 53)
    x, c = np.full((2, 64), float(top)), centroids._exact(np.full((1, 64), -float(top)))
    assert centroids.distances(x, c).tolist() == [[64 * 4 * top * top]] * 2


def test_one_row_of_sums_for_a_batch(spark):
    """What is added up doesn't grow with the rows of a batch, and the hot cluster of equal vectors is no special case."""
    rows = vectors(spark, [(i, [0.5] * 64) for i in range(2000)])
    out = centroids.cluster(rows, k=3)
    assert out.where(F.col("cluster") == 0).count() == 2000
