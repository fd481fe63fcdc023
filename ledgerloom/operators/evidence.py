"""Evidence: quotes against sources, in blocks of quotes of a fixed number of bytes, so that what is broadcast never grows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256, squeezed, strip
from ..plans.rounds import appended

#: Characters of quotes that every task holds at once, and of a quote's beginning that is looked up in the texts.
QUOTE_CHARS, ANCHOR = 16 << 20, 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rolled(text: str, k: int) -> np.ndarray:
    """A hash of each k characters of a text in a row."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = np.zeros(max(0, len(codes) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * _FACTOR + codes[j : j + len(out)]
    return out


class _Quotes:
    """Quotes by the hash of their first characters, in groups of one length of beginning."""

    def __init__(self, quotes: list[str]):
        self.rows = [(q, "".join(q.split())) for q in quotes]
        groups: dict[int, dict[int, list[int]]] = {}
        for at, (_, packed) in enumerate(self.rows):
            if packed:
                k = min(ANCHOR, len(packed))
                groups.setdefault(k, {}).setdefault(int(_rolled(packed[:k], k)[0]), []).append(at)
        self.groups = [(k, np.array(sorted(g), np.uint64), g) for k, g in groups.items()]

    def inside(self, text: str) -> list[int]:
        """Places of the quotes that a text holds, white space aside."""
        packed, found = "".join(text.split()), set()
        for k, keys, group in self.groups:
            hashes = _rolled(packed, k)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            for i in np.flatnonzero(keys[at] == hashes).tolist():
                found.update(q for q in group[int(hashes[i])] if q not in found and packed.startswith(self.rows[q][1], i))
        return sorted(found)


def quote_matches(quotes: DataFrame, sources: DataFrame, block: int = QUOTE_CHARS) -> DataFrame:
    """(item_id, doc_id, match_mode) of quotes (item_id, quote) that sources (doc_id, text) hold, exactly or white space aside.

    Every text is read once for each block of quotes: the hash of each of its runs of characters is looked up among the
    beginnings of all quotes of the block, and what is found is compared whole. Nothing but matches is shuffled. If there
    are several blocks, their matches are written one after another, so that the tasks hold one block at a time.
    """
    spark, good = sources.sparkSession, quotes.where(strip("quote") != "").select("item_id", "quote")
    blocks = max(1, math.ceil((good.agg(F.sum(F.length("quote"))).first()[0] or 0) / block))
    texts = sources.select("doc_id", "text").where("text is not null")
    modes = F.lit("").alias("match_mode")
    schema = good.select("item_id").join(texts.select("doc_id")).select("item_id", "doc_id", modes).schema

    def found(held) -> DataFrame:
        def each(batches):
            ids, index = held.value.column(0), _Quotes(held.value.column(1).to_pylist())
            for batch in batches:
                items, at, mode = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for q in index.inside(text):
                        items.append(q)
                        at.append(i)
                        mode.append("exact" if index.rows[q][0] in text else "whitespace_normalized")
                if items:
                    own = ids.take(pa.array(items)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([own, batch.column(0).take(pa.array(at)), pa.array(mode)], ["item_id", "doc_id", "match_mode"])

        return texts.mapInArrow(each, schema)

    send = lambda part: spark.sparkContext.broadcast(part.toArrow().combine_chunks())  # noqa: E731  QUOTE_CHARS at most, or so
    if blocks == 1:
        return found(send(good))

    def one_by_one():
        for b in range(blocks):
            held = send(good.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == b))
            yield found(held)
            held.destroy()

    return appended(one_by_one(), "matches")


def gate(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """C05 over all sources: a row per match; quotes without any get one row with a reject_reason."""
    found = quote_matches(quotes, sources)
    reason = F.when(strip("quote") == "", "empty quote").when(F.col("doc_id").isNull(), "quote not in any source")
    return quotes.join(found, "item_id", "left").select("item_id", "doc_id", "match_mode", sha256("quote").alias("quote_sha256"), reason.alias("reject_reason"))


def cited(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """J01 and C05 for evidence that names its source (candidate_id, doc_id, quote): match_mode or reject_reason per item."""
    rows = evidence.join(sources.select("doc_id", "text"), "doc_id", "left")
    exact = F.col("text").contains(F.col("quote"))
    loose = squeezed("text").contains(squeezed("quote"))
    reason = F.when(F.col("text").isNull(), "unknown source").when(strip("quote") == "", "empty quote").when(~exact & ~loose, "quote not in source")
    return rows.select("candidate_id", "doc_id", "quote", F.when(reason.isNull(), F.when(exact, "exact").otherwise("whitespace_normalized")).alias("match_mode"), sha256("quote").alias("quote_sha256"), reason.alias("reject_reason"))


def admitted(items: DataFrame) -> DataFrame:
    """Candidates (candidate_id, admitted, items): one bad item voids the whole candidate."""
    return items.groupBy("candidate_id").agg(F.bool_and(F.col("reject_reason").isNull()).alias("admitted"), F.count(F.lit(1)).alias("items"))


def merged(evidence: DataFrame) -> DataFrame:
    """Evidence of duplicate points, once per (node, source, quote digest)."""
    return evidence.dropDuplicates(["node_id", "source_id", "quote_sha256"])


def citation(evidence: DataFrame) -> DataFrame:
    """The first source of each evidence unit by sequence."""
    order = Window.partitionBy("evidence_id").orderBy("seq", "source_id")
    return evidence.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
