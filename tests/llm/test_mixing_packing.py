"""Mixing against the sequential rule, packing against the tokenizer itself."""

import hashlib
import zlib

import numpy as np
import pytest

from ledgerloom.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, size int, ids binary"
public = pytest.importorskip("public_tokenizers")
BPE = public.path("byte_bpe_50k.json")
TRICKY = ["", " ", "  two  spaces ", "a\nb\n\nc", "tab\t x", "it's we'll don't", "x \n y", " lead", "trail ", "ünïcode ßtraße", "<|endoftext|> a <|endoftext|>", "日本 語 text", "1 22 333,4 $$$ %%% !!", "nb sp  x", "a  b", "\x1c x \x1c y", "😀 😀😀", "a\r\n b"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 7, 7, None) for i, t, s in rows], SCHEMA)


def hash_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def plain_mix(rows):
    """Excess reshared step by step, documents taken in the order of their hash."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = 1.5 * sum(size.values())
    target, free, left = dict.fromkeys(order, 0.0), set(order), total
    while free and left > 1e-9:
        add = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        left = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] > 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = float(2 * size[s])
                free.discard(s)
    return size, target


def test_mix_follows_targets(spark):
    rows = [(i, "w " * (i * 37 % 50), "abcde"[min(4, i % 9)]) for i in range(400)] + [(500, None, None), (501, "x y", None), (501, "x y", None), (None, "q r s", "a")]
    size, target = plain_mix(rows)
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = {}
    by_id = {}
    for i, t, s in rows:
        by_id[i] = s
    for r in out:
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        taken[s] = taken.get(s, 0) + r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 50
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert sum(len((r.text or "").split()) for r in mixing.mixed_rows(docs(spark, rows)).collect()) == sum(taken.values())
    assert mixing.mixed_rows(docs(spark, rows)).columns == docs(spark, rows).columns


def test_rows_that_share_a_hash_reach_the_target(spark):
    rows = [(None, "w " * 10, "a") for _ in range(100)] + [(7, "w " * 10, "b") for _ in range(100)] + [(i, "w " * 10, "c") for i in range(100)]
    size, target = plain_mix(rows)
    out = mixing.mix(docs(spark, rows)).collect()
    for t, s in zip((target["a"], target["b"]), ("a", "b"), strict=True):
        mine = [r for r in out if r.doc_id == {"a": None, "b": 7}[s]]
        mine = [r for r in mine if r.target == pytest.approx(t)]
        assert abs(sum(r.taken for r in mine) - t) <= 5
    kept = mixing.mixed_rows(docs(spark, rows)).groupBy("source").count().collect()
    assert all(abs(10 * r["count"] - target[r.source]) <= 5 for r in kept)
    nulls = [(None, "w " * 3, None) for _ in range(40)]
    assert sum(r.taken for r in mixing.mix(docs(spark, nulls)).collect()) == pytest.approx(180, abs=2)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, sf):
    encode, dtype = packing.encoder(BPE)
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for t in texts:
        assert np.frombuffer(encode(t), dtype).tolist() == reference_ids(t), repr(t[:50])


def test_pack_round_trip(spark):
    rows = [(i, TRICKY[i % len(TRICKY)] * (1 + 40 * (i % 3)), None) for i in range(60)] + [(99, None, None), (7, "again", None), (7, "again", None), (None, "no id", None), (100, "long word " * 30_000, None)]
    pieces = packing.pack(docs(spark, rows).repartition(5), BPE).collect()
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    end = 0
    for s, o, n in at:
        assert s * 1024 + o == end and 0 < n and o + n <= 1024
        end += n
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append([*reference_ids(t or ""), 0])
    assert end == sum(len(x) for v in want.values() for x in v)
    for p in pieces:
        options = [x for x in want[p.doc_id] if len(x) == p.doc_tokens]
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in options)
    assert packing.pack(docs(spark, []), BPE).count() == 0
