"""Exact dedup with a persistent digest index, bucketed and sorted by digest.

A batch is reduced to its distinct digests (pre-aggregated, so a hot text is one row a task), sort-merge anti-joined with
the index, whose buckets need no shuffle, and what is new is appended. Only digests and places of rows are shuffled; whole
rows are, once, if more are dropped than common.BROADCAST_ROWS.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, lookup, materialize, rows_without, shared_dir, unique_name, with_row_key

BUCKETS = 64
#: ASCII white space, fixed by the contract.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class DigestIndex:
    """A table (digest binary, keep_id, batch) at `path`, bucketed and sorted by digest.

    A batch may be added again under its name, for instance after a run that failed: what it had brought counts as new
    again, and nothing is appended twice.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, id_type: str = "long"):
        self.spark, self.buckets, self.id_type, self.name = spark, buckets, id_type, unique_name("ledgerloom_digests")
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        spark.sql(f"create table {self.name} (digest binary, keep_id {id_type}, batch string) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{self.path}'")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame) -> None:
        spread = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        spread.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").saveAsTable(self.name)

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Append the digests of groups (digest, keep_id, ...) that are new; groups with the index's keep_id and is_new."""
        groups = materialize(groups, "groups")
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        self._append(new.withColumn("batch", F.lit(batch)))
        found = self.table().select("digest", "keep_id", (F.col("batch") == batch).alias("is_new"))
        return materialize(groups.drop("keep_id").join(found.hint("merge"), "digest"), "fates")

    def compact(self, path: str | None = None) -> DigestIndex:
        """The same index at another path with one file a bucket, for when many batches were appended; this one stays as it is."""
        out = DigestIndex(self.spark, path, self.buckets, self.id_type)
        out._append(self.table())
        return out

    def drop(self, files: bool = False) -> None:
        """Forget the table; its files stay unless `files`."""
        self.spark.sql(f"drop table {self.name}")
        if files:
            delete(self.spark, self.path)


def _fates(keyed: DataFrame, index: DigestIndex | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """doc_id, file, row, digest of every row; of every distinct digest, keep_id, its first row here, group_size, is_new."""
    id_type = keyed.select("doc.doc_id").schema["doc_id"].dataType.simpleString()
    own = index or DigestIndex(keyed.sparkSession, id_type=id_type)
    digest = F.unhex(F.sha2(normalised(F.col("doc.text")).cast("binary"), 256)).alias("digest")
    rows = materialize(keyed.select("doc.doc_id", "file", "row", digest), "digests")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("best")
    groups = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
    fates = own.add(groups.select("digest", F.col("best.doc_id").alias("keep_id"), "best", "group_size"), batch or uuid.uuid4().hex)
    if index is None:
        own.drop(files=True)
    return rows, fates


#: Whether a row is the first of its group, in a batch that brought the digest.
_STAYS = "is_new and file = best.file and row = best.row"


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of a batch.

    Null texts count as empty and form a group like any other; texts of any length are read whole. Of rows with equal text
    and equal smallest doc_id (ties, repeated rows), the first as stored is kept. A group whose digest an earlier batch
    brought keeps that batch's id and no row of this batch. Rows with a null doc_id are kept only if no row of the group
    has an id. An empty batch gives an empty result; extra columns of any name are left out. batch: a name under which the
    batch may be added again with the same result; none: a new one.
    """
    rows, fates = _fates(with_row_key(docs), index, batch)
    out = lookup(rows, fates, "digest", "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", F.expr(_STAYS).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts left: that with the smallest doc_id (of several, the first as stored).

    Nulls, empty and long texts, ties and empty tables as in dedup; every column of docs stays, whatever its name.
    """
    keyed = with_row_key(docs)
    rows, fates = _fates(keyed, None, None)
    dropped = lookup(rows, fates.where("group_size > 1"), "digest", "group_size", rows.count()).where(f"not ({_STAYS})")
    return rows_without(keyed, dropped).select("doc.*")
