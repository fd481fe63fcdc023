"""Packing: concatenate and cut.

Pass one tokenises each partition and writes the ids with each document's offset in its partition; the partitions' totals
give every partition its global offset; pass two cuts documents at fixed windows. No token is shuffled. What pass one
wrote is fixed, so a lost executor or a retried task cannot move an offset.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, materialize, running_offsets

LENGTH, END = 1024, 0
#: Words whose ids a worker remembers.
CACHE_WORDS = 120_000
#: The pre-tokenisation pattern of byte-level BPE, a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str):
    """A function from a text to its ids as packed little-endian integers, and their dtype.

    Equal to the `tokenizers` library on the same file with add_special_tokens=False, special tokens' strings counting as
    ordinary text. A single space between two characters that aren't white space always begins a token, so the words
    between such spaces are encoded apart and remembered.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = _byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
    uneven = re.compile(r" (?:(?=\s)|(?<=\s\s)|(?<=^ )|$)")
    between = re.compile(r"(?<=\S) (?=\S)")

    class Words(dict):
        def __missing__(self, word):
            ids = np.array(bpe.encode_ordinary(word), dtype).tobytes()
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
            return ids

    class Later(Words):
        def __missing__(self, word):
            ids = np.array(bpe.encode_ordinary(" " + word), dtype).tobytes()
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
            return ids

    firsts, later = Words(), Later()

    def encode(text: str) -> bytes:
        if not text:
            return b""
        head, *words = between.split(text) if uneven.search(text) else text.split(" ")
        return firsts[head] + b"".join(map(later.__getitem__, words))

    return encode, dtype


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, ids (packed integers, `end` last), part and local (ids before it in its part), written once."""

    def each(batches):
        encode, dtype = encoder(path)
        last, at, part = np.array([end], dtype).tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = [encode(t or "") + last for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), part, np.int32)), pa.array(local), pa.array(n)], ["doc_id", "ids", "part", "local", "n"])

    picked = docs.select("doc_id", "text")
    schema = picked.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("part", "int"), ("local", "long"), ("n", "long")))).schema
    return materialize(picked.mapInArrow(each, schema), "tokens", ARROW_ROWS)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow each other in the order in which they are stored and are cut where a sequence is full, so only the
    last sequence needs padding. Null and empty texts are one id (`end`), long texts as many pieces as they fill; repeated
    rows are packed as often as they come; an empty table gives no pieces; extra columns of any name are left out.
    """
    rows = tokenised(docs, path, end)
    totals = rows.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("total"))
    placed = rows.join(F.broadcast(running_offsets(totals, "part", "total")), "part")  # a row for each task of pass one
    placed = placed.select("doc_id", "ids", (F.col("local") + F.col("part_offset")).alias("at"))

    def each(batches):
        _, dtype = encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(7)]
            for row, (raw, at) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), dtype).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    for c, v in zip(cols, (row, start, size, zlib.crc32(ids[start : start + size]), n, sequence, offset), strict=True):
                        c.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    schema = placed.select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))).schema
    return placed.mapInArrow(each, schema)
