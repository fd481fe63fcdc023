"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket; the bucket in which a source's budget runs out is split again by the next
hash bits until one hash value is left, and documents are then taken by comparing their hash with the thresholds. Nothing
is sorted by document; every pass pre-aggregates, so a source with a third of all rows is no heavier than another. Where
several rows share the hash at which a budget runs out (equal or null ids), the same is done over a hash of their places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, lookup, materialize, with_row_key

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: 60 hash bits, 12 at a time.
BITS, STEP = 60, 12


def _bits(text):
    """60 hash bits of a text column."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


#: The source as a non-null key, null last.
_SKEY = "if(doc.source is null, 'z', concat('a', cast(doc.source as string)))"


def _keyed(docs: DataFrame) -> DataFrame:
    """with_row_key's columns, skey, h (hash bits of the id) and h2 (of the row's place)."""
    own = _bits(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")))
    return with_row_key(docs).select("doc", F.expr(_SKEY).alias("skey"), own.alias("h"), _bits(F.concat_ws(":", "file", "row")).alias("h2"))


def sizes(keyed: DataFrame) -> DataFrame:
    """doc_id, skey, size in words, h, h2."""
    size = F.coalesce(F.regexp_count(F.col("doc.text"), F.lit(WORD)), F.lit(0)).cast("long")
    return keyed.select("doc.doc_id", "skey", size.alias("size"), "h", "h2")


def targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """per_source (skey, source_size, n) with column target: `share` of all words by weight, excess over `most` reshared.

    Resharing until no source is above its limit gives every other source the same words per unit of weight; that rate is
    found by repeated aggregation, each round fixing the sources that are above.
    """
    ranked = global_rank(per_source, "skey")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("skey", "source_size", "n", w.alias("w"), (F.col("source_size") * most).alias("limit")), "sources")
    budget, rate = share * (ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        above = F.col("limit") < F.lit(rate) * F.col("w")
        fixed, left = ranked.agg(F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("w")))).first()
        if not left or (after := (budget - (fixed or 0)) / left) <= rate:
            break
        rate = after
    return ranked.select("skey", "source_size", "n", F.least(F.col("limit").cast("double"), F.lit(rate) * F.col("w")).alias("target"))


def _cut(slim: DataFrame, start: DataFrame) -> DataFrame:
    """skey, theta, tie and below: the words of rows with h below theta come as near to `rest` as whole rows can.

    slim: skey, size, h; start: skey, rest. If several rows share the hash at which `rest` is reached, tie is that hash
    (null otherwise) and below the words under it.
    """
    state = materialize(start.withColumns({"below": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long"), "theta": F.lit(None).cast("long"), "tie": F.lit(None).cast("long")}), "state")
    order = Window.partitionBy("skey").orderBy("bucket")
    for level in range(1, BITS // STEP + 1):
        shift, wide = BITS - STEP * level, BITS - STEP * (level - 1)
        open_ = state.where("theta is null")
        if level > 1 and open_.isEmpty():
            break
        rows = slim.withColumn("prefix", F.shiftright("h", wide))
        if level > 1:
            rows = rows.join(open_.select("skey", "prefix"), ["skey", "prefix"], "left_semi")
        sums = rows.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("rows"))
        filled = sums.join(open_.select("skey", "rest", "below"), "skey").withColumn("upto", F.col("below") + F.sum("words").over(order))
        first = F.min_by(F.struct("bucket", "words", "lo", "hi", "rows", "upto"), "bucket").alias("edge")
        edge = filled.where("upto > rest").groupBy("skey").agg(first)
        joined = state.join(edge, "skey", "left")
        before = F.col("edge.upto") - F.col("edge.words")
        single = F.col("edge.lo") == F.col("edge.hi")
        several = single & (F.col("edge.rows") > 1)
        nearer = F.when(~several & (F.col("edge.upto") - F.col("rest") < F.col("rest") - before), F.col("edge.hi") + 1).otherwise(F.col("edge.lo"))
        done = F.when(F.col("theta").isNotNull(), F.col("theta")).when(F.col("edge").isNull(), F.lit(1 << BITS)).when(single, nearer)
        tie = F.when(F.col("theta").isNull() & several, F.col("edge.lo")).otherwise(F.col("tie"))
        state = materialize(joined.select("skey", "rest", F.coalesce(before, "below").alias("below"), F.coalesce("edge.bucket", "prefix").alias("prefix"), done.alias("theta"), tie.alias("tie")), "state")
    return state


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """skey, base (whole copies of the source), theta, tie and theta2.

    Rows with h below theta are taken once more, and so are those whose h is tie with h2 below theta2. slim: skey, size, h,
    h2. The words of the rows taken once more come as near to what the whole copies leave of the target as whole documents
    can, with documents in the order of their hashes.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    start = goals.select("skey", base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("rest"))
    cut = _cut(slim, start.select("skey", "rest"))
    ties = cut.where("tie is not null")
    out = start.select("skey", "base").join(cut.select("skey", "theta", "tie"), "skey")
    if ties.isEmpty():
        return out.withColumn("theta2", F.lit(None).cast("long"))
    tied = slim.join(ties.select("skey", F.col("tie").alias("h")), ["skey", "h"], "left_semi").select("skey", "size", F.col("h2").alias("h"))
    inner = _cut(tied, ties.select("skey", (F.col("rest") - F.col("below")).alias("rest")))
    return out.join(inner.select("skey", F.col("theta").alias("theta2")), "skey", "left")


def _plan(slim: DataFrame, weights, share, most) -> DataFrame:
    per_source = slim.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = materialize(targets(per_source, weights, share, most), "targets")
    return goals.join(thresholds(slim, goals), "skey")


_COPIES = "cast(base + if(h < theta or coalesce(h = tie and h2 < theta2, false), 1, 0) as int)"


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row.

    Documents are taken whole, none to `most` times. Null and empty texts have size 0, long ones are counted whole; null
    sources form one source, last in order; rows with equal or null ids are told apart by their places if the budget runs
    out among them; reruns over the same files agree. An empty table gives an empty result; extra columns of any name are
    left out.
    """
    slim = materialize(sizes(_keyed(docs)), "sizes")
    out = lookup(slim, _plan(slim, weights, share, most), "skey", "n", slim.count())
    return out.select("doc_id", "size", "source_size", "target", (F.expr(_COPIES) * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs, each row as often as the mix takes it (none to `most` times); cases as in mix, every column stays as it is."""
    keyed = _keyed(docs)
    slim = materialize(sizes(keyed), "sizes")
    plan = _plan(slim, weights, share, most).select("skey", "n", "base", "theta", "tie", "theta2")
    taken = lookup(keyed, plan, "skey", "n", slim.count()).select("doc", F.expr(_COPIES).alias("copies"))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")
