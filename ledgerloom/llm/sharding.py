"""Sharding by a communication matrix: a uniform shuffle of all rows into shards of exact sizes.

Rows stand in chunks (runs of a file), shards are cut into blocks. How many rows each chunk sends to each block is drawn
from the exact joint law (multivariate hypergeometric), so that every chunk sends what it has and every block gets what it
holds. The matrix is never made whole: it is drawn by halving the chunks again and again, each half seeded by its own
place, so every task draws just the way down to its chunk and all agree. A chunk permutes its rows and deals them by its
matrix row; after the exchange each block permutes again. Together that is one uniform permutation of all rows, and no task
holds more than a chunk's places or a block's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, with_row_key

SHARDS, SEED = 8, 42
#: Rows of a file that are permuted together, and rows of a shard that are.
CHUNK_ROWS, BLOCK_ROWS = 1 << 20, 1 << 14
#: Numpy draws hypergeometric numbers for fewer rows than this; beyond, `_drawn` does.
NUMPY_ROWS = 1_000_000_000


def _log_factorial_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln(a!) - ln(b!) for whole numbers near each other, without the cancellation of two large logarithms."""
    a, b = a.astype(np.float64) + 1, b.astype(np.float64) + 1
    shift = np.zeros_like(a)
    for _ in range(10):  # the series below needs numbers of 10 or more
        shift += np.where(a < 10, -np.log(a), 0) + np.where(b < 10, np.log(b), 0)
        a, b = np.where(a < 10, a + 1, a), np.where(b < 10, b + 1, b)
    tail = lambda x: (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return shift + (b - 0.5) * np.log1p((a - b) / b) + (a - b) * (np.log(a) - 1) + tail(a) - tail(b)


def _drawn(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Hypergeometric numbers for any number of rows: the ratio of uniforms (Stadlober's H2PE relative HRUA), in arrays."""
    low, high, total = np.minimum(good, bad), np.maximum(good, bad), good + bad
    m = np.minimum(sample, total - sample)
    p = low / total
    centre = m * p + 0.5
    spread = np.sqrt((total - m) * (m / (total - 1)) * p * (1 - p) + 0.5)
    height = 2 * np.sqrt(2 / np.e) * spread + 3 - 2 * np.sqrt(3 / np.e)
    mode = np.floor((m + 1) * ((low + 1) / (total + 2))).astype(np.int64)
    mode = np.clip(mode, np.maximum(0, m - high), np.minimum(m, low))
    out, open_ = np.zeros(len(total), np.int64), np.arange(len(total))
    while len(open_):
        u, v = 1 - rng.random(len(open_)), rng.random(len(open_))
        i = open_
        x = np.floor(centre[i] + height[i] * (v - 0.5) / u)
        fit = (x >= np.maximum(0, m[i] - high[i])) & (x <= np.minimum(m[i], low[i]))
        k = np.where(fit, x, mode[i]).astype(np.int64)
        q = mode[i]
        step = -sum(_log_factorial_step(a, b) for a, b in ((k, q), (low[i] - k, low[i] - q), (m[i] - k, m[i] - q), (high[i] - m[i] + k, high[i] - m[i] + q)))
        taken = fit & (2 * np.log(u) <= step)
        out[i[taken]] = k[taken]
        open_ = i[~taken]
    out = np.where(good > bad, m - out, out)
    return np.where(m < sample, good - out, out)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """How many of `sample` rows out of good + bad are good; arrays of whole numbers below 2^52."""
    out, large = np.zeros(len(good), np.int64), good + bad >= NUMPY_ROWS
    small = ~large & (sample > 0)
    out[small] = rng.hypergeometric(good[small], bad[small], sample[small])
    if large.any():
        sure = large & ((good == 0) | (bad == 0) | (sample == 0) | (sample == good + bad))
        out[sure] = np.minimum(good, sample)[sure]
        rest = large & ~sure
        out[rest] = _drawn(rng, good[rest], bad[rest], sample[rest])
    return out


def split(rng: np.random.Generator, counts: np.ndarray, sample: int) -> np.ndarray:
    """How many of `sample` rows drawn without return are of each kind, of which there are `counts`: by halves of the kinds."""
    levels = [counts]
    while len(levels[-1]) > 1:
        c = levels[-1]
        levels.append(np.add.reduceat(c, np.arange(0, len(c), 2)))
    got = np.array([sample], np.int64)
    for c in levels[-2::-1]:
        left, right = c[0::2], c[1::2]
        pairs = len(right)
        out = np.zeros(len(c), np.int64)
        out[0::2] = got  # an odd one at the end takes all of its pair
        out[0 : 2 * pairs : 2] = hypergeometric(rng, left[:pairs], right, got[:pairs])
        out[1::2] = got[:pairs] - out[0 : 2 * pairs : 2]
        got = out
    return got


class Matrix:
    """The communication matrix of chunks (rows each) and of the blocks of `shards` shards as near equal as can be."""

    def __init__(self, chunk_rows: np.ndarray, shards: int, block_rows: int, seed: int):
        self.ends = np.concatenate(([0], np.cumsum(chunk_rows, dtype=np.int64)))
        total, self.seed = int(self.ends[-1]), seed
        sizes = [total // shards + (k < total % shards) for k in range(shards)]
        blocks = [(k, start, min(block_rows, n - start)) for k, n in enumerate(sizes) for start in range(0, n, block_rows)]
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int32))  # rows of a chunk come one after another
        self.shard, self.start, self.size = (np.array(c, np.int64) for c in zip(*blocks, strict=True)) if blocks else [np.zeros(0, np.int64)] * 3

    def row(self, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks to which a chunk sends rows, and how many: the same in every task that asks."""
        low, high = 0, len(self.ends) - 1
        ids, counts = np.arange(len(self.size)), self.size
        while high - low > 1:
            mid = (low + high) // 2
            left = split(np.random.default_rng([self.seed, low, high]), counts, int(self.ends[mid] - self.ends[low]))
            if chunk < mid:
                counts, high = left, mid
            else:
                counts, low = counts - left, mid
            ids, counts = ids[counts > 0], counts[counts > 0]
        return ids, counts

    def dealt(self, chunk: int) -> np.ndarray:
        """The block of each row of a chunk, in the order in which they stand."""
        if self.last[0] != chunk:
            ids, counts = self.row(chunk)
            self.last = chunk, np.random.default_rng([self.seed, chunk]).permutation(np.repeat(ids, counts).astype(np.int32))
        return self.last[1]


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc (the whole row as a struct), shard and slot of every row: a uniform permutation dealt to shards.

    Law `rows`: shard sizes differ by one at most, the first shards get the larger ones; slots have no gaps from 0. The
    content of a row plays no part, so nulls, empty and very long texts, ties and repeated rows are dealt like any other,
    each row once; an empty table gives an empty result; columns of any name ride in doc. The result follows the seed, the
    order of the files' names and the rows in them, so a rerun, a lost task or another folder changes nothing. Only a
    number for each input file comes to the driver and is broadcast; a file's chunk holds 4 bytes a row.
    """
    spark, keyed = docs.sparkSession, with_row_key(docs, path=True)
    files = sorted((r.path, r.file, r.n) for r in keyed.groupBy("path", "file").agg(F.count(F.lit(1)).alias("n")).collect())
    if len({f for _, f, _ in files}) < len(files):
        raise ValueError("two files share a hash of their paths")
    pieces = [(f, min(chunk_rows, n - at)) for _, f, n in files for at in range(0, n, chunk_rows)]
    first: dict[int, int] = {}
    for i, (f, _) in enumerate(pieces):
        first.setdefault(f, i)
    plan = spark.sparkContext.broadcast((first, Matrix(np.array([n for _, n in pieces], np.int64), shards, block_rows, seed)))

    @F.pandas_udf("shard int, start long, chunk long, at int")
    def place(file: pd.Series, row: pd.Series) -> pd.DataFrame:
        firsts, matrix = plan.value
        at = row.to_numpy()
        chunk = file.map(firsts).to_numpy(np.int64) + at // chunk_rows
        block = np.empty(len(at), np.int64)
        for c in np.unique(chunk).tolist():
            block[chunk == c] = matrix.dealt(c)[at[chunk == c] % chunk_rows]
        return pd.DataFrame({"shard": matrix.shard[block].astype(np.int32), "start": matrix.start[block], "chunk": chunk, "at": (at % chunk_rows).astype(np.int32)})

    placed = keyed.select("doc", place("file", "row").alias("to")).select("doc", "to.*")
    order = Window.partitionBy("shard", "start").orderBy(F.xxhash64(F.lit(seed), "chunk", "at"), "chunk", "at")
    return placed.select("doc", "shard", (F.col("start") + F.row_number().over(order) - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED) -> str:
    """The shards as folders (shard=k) of Parquet files with the columns of docs and slot, each file in slot order; the path."""
    out = path or f"{shared_dir(docs.sparkSession)}/shards"
    rows = sharded(docs, shards, seed).select("shard", "slot", "doc.*")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
    return out


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law, shard, slot and grown_shard (null: of the law `key` only).

    A null text has no bytes and their crc32, 0. Equal texts are dealt apart like any rows: the method keeps no groups.
    """
    text = F.coalesce("doc.text", F.lit(""))
    out = sharded(docs, shards, seed)
    return out.select("doc.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
