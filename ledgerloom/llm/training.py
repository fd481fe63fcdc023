"""Bounded samples of labelled rows, which the two classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_held_out


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[dict[int, int], Iterator]:
    """Training rows by class, and an iterator over a sample of them as (doc_id, text, y), `per_class` at most of each.

    Only rows whose id doesn't fall into the held-out fifth are used; the sample is those with the smallest hashes of
    the id. The rows reach the driver one after the other, in the order of their hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~crc_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for y in sorted(counts):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return {}, iter(())
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most per_class rows of each class
    rows = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    return counts, rows.orderBy(order, "doc_id").toLocalIterator()
