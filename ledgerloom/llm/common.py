"""What several operators share: written intermediates, row keys, skew-safe look-ups, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import delete, shared_dir, written
from ..plans.rounds import drop_written as drop_materialized

__all__ = ["delete", "drop_materialized", "materialize", "shared_dir"]
#: Keys with more rows than this share of all rows are looked up by broadcast; there can be at most its inverse of them.
HOT_SHARE = 1 / 1000
#: Places of rows (16 bytes each) up to which they are broadcast; more meet the rows in a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of whole texts or shingle sets that go to a Python worker at once; what they take is held outside of the heap.
ARROW_ROWS = 500
#: Rows of such batches where a worker holds more of each row than its text: whole rows that come back, shingle sets.
WHOLE_ROWS = 128


def materialize(df: DataFrame, label: str, arrow_rows: int | None = None) -> DataFrame:
    """plans.rounds.written; arrow_rows: rows of the Arrow batches that this write sends to Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, arrow_rows or before)
    try:
        return written(df, label)
    finally:
        conf.set(name, before)


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per key, safe when one key holds a third of the rows.

    groups has one row for each key with its row count in column `size`. Keys above HOT_SHARE of `total` rows number at
    most 1 / HOT_SHARE, so those few are broadcast; the others, each a small share, meet in an ordinary shuffle join.
    """
    limit, groups = max(1, int(total * HOT_SHARE)), materialize(groups, "groups")
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    hot_keys = hot.select(F.col(key).alias("__hot"))
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot_keys), rows[key] == F.col("__hot"), "left_anti").join(cold, key)
    return near.unionByName(far)


def with_row_key(docs: DataFrame, path: bool = False) -> DataFrame:
    """Columns doc (the whole row as a struct, so that no name can clash), file, row and, if asked for, path.

    file (a 64-bit hash of the path) and row (the place in that file) tell even fully equal rows apart and stay the same
    in every read. A plain read of files, filtered or not, supplies them; anything else is written to the shared folder
    first.
    """
    if not (plain := _plain_read(docs)):
        docs = materialize(docs.select(F.struct("*").alias("doc")), "rows")
    place = docs.metadataColumn("_metadata")
    doc = F.struct("*") if plain else F.col("doc")
    own = [place["file_path"].alias("path")] if path else []
    return docs.select(doc.alias("doc"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"), *own)


def _plain_read(docs: DataFrame) -> bool:
    """Whether docs is a file source below nothing but filters, so that each row of it is one row of a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Filter":
        plan = plan.child()
    return plan.nodeName().startswith("LogicalRelation") or plan.getClass().getSimpleName() == "LogicalRelation"


def places(rows: DataFrame) -> DataFrame:
    """rows (file, row, ...), written, to be joined with with_row_key's rows: those are shuffled only if places are many."""
    held = materialize(rows, "places")
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def rows_without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of with_row_key's `keyed` whose file and row are not in `dropped`."""
    return keyed.join(places(dropped.select("file", "row")), ["file", "row"], "left_anti")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is an error, others (clashing names included) are left out."""
    return df.select(*names)


def running_offsets(df: DataFrame, part: str, total: str) -> DataFrame:
    """Exclusive prefix sums of `total` by `part`. df has one row for each task of a stage, which bounds it."""
    window = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(part, F.coalesce(F.sum(total).over(window), F.lit(0)).alias("part_offset"))


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """df with column rank (from 0) in ascending order of the distinct values of `key`, without one global sort task."""
    parts = materialize(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    offsets = running_offsets(parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__part", "__n")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return parts.withColumn("__in", within).join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__in") + F.col("part_offset")).drop("__part", "__in", "part_offset")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (a, b): one row (v, c) per vertex, c being the component's smallest vertex.

    Alternating large-star and small-star contractions; each round is written to the shared folder. Towards the end the
    smallest vertex of a large component meets all the others, so every join by vertex treats hot vertices apart.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, count = None, current.count()
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both.where("v > u"), low, "u", "n", 2 * count).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, least, "a", "n", large.count()).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = materialize(small, "edges")
        drop_materialized(current)
        drop_materialized(large)
        stars = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        current, count = after, stars[0]
        if mark == stars or count == 0:
            break
        mark = stars
    vertices = current.select(F.col("a").alias("v"), F.col("b").alias("c"))
    return vertices.union(current.select("b", "b").distinct())


def unique_name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:12]}"


def crc_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
