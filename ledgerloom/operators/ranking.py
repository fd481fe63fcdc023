"""Relevance ranking and capped selections."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import appended

#: Questions that every task holds at once.
QUESTION_BLOCK = 5000
_LATIN, _HAN = re.compile("[a-zA-Z][a-zA-Z0-9_]+"), re.compile("[一-鿿]{2,}")


def term_set(text: str) -> set[str]:
    """T07 of one string, as `terms` of a column."""
    return {*_LATIN.findall(text.lower()), *(run[i : i + 2] for run in _HAN.findall(text) for i in range(len(run) - 1))}


class _Questions:
    """The terms of questions, every distinct one counted once a text."""

    def __init__(self, rows: list[list[str] | None]):
        self.words = sorted({t.lower() for terms in rows for t in terms or () if len(t) >= 2})
        number = {w: i for i, w in enumerate(self.words)}
        self.rows = [([(number[t.lower()], len(t) + 3) for t in terms or () if len(t) >= 2], set().union(*map(term_set, terms or ()))) for terms in rows]

    def scores(self, text: str):
        """(place of the question, score) of the questions that score above 0."""
        low, own = text.lower(), term_set(text)
        counts = [min(low.count(w), 4) for w in self.words]
        weight = 0.1 if text.count(".") > 30 and "目录" in text else 1.0
        for i, (words, shared) in enumerate(self.rows):
            if score := (sum(counts[w] * n for w, n in words) + 0.3 * len(own & shared)) * weight:
                yield i, score


def scored(chunks: DataFrame, questions: DataFrame, block: int = QUESTION_BLOCK) -> DataFrame:
    """Score > 0 of chunks (chunk_id, text) for questions (question_id, terms), questions in blocks of a fixed size.

    A chunk is lowered and split once a block, and each distinct term of a block is counted once a chunk. The scores of
    several blocks are written one after another, so that the tasks hold one block at a time.
    """
    spark, blocks = chunks.sparkSession, max(1, -(-questions.count() // block))
    texts, asked = chunks.select("chunk_id", "text").where("text is not null"), questions.select("question_id", "terms")
    schema = asked.select("question_id").join(texts.select("chunk_id")).select("question_id", "chunk_id", F.lit(0.0).alias("score")).schema

    def found(held) -> DataFrame:
        def each(batches):
            ids, index = held.value.column(0), _Questions(held.value.column(1).to_pylist())
            for batch in batches:
                rows = [(q, i, score) for i, text in enumerate(batch.column(1).to_pylist()) for q, score in index.scores(text)]
                if rows:
                    q, at, score = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)).combine_chunks(), batch.column(0).take(pa.array(at)), pa.array(score)], ["question_id", "chunk_id", "score"])

        return texts.mapInArrow(each, schema)

    send = lambda part: spark.sparkContext.broadcast(part.toArrow().combine_chunks())  # noqa: E731  `block` questions, or so
    if blocks == 1:
        return found(send(asked))

    def one_by_one():
        for b in range(blocks):
            held = send(asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b))
            yield found(held)
            held.destroy()

    return appended(one_by_one(), "scores")


def top(df: DataFrame, n: int, by: list[str], *order: Column | str) -> DataFrame:
    """The first n rows of each group, in a total order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def select_chunks(scores: DataFrame, limit: int, nominate: int = 2) -> DataFrame:
    """S-4: chunks nominated by questions weigh the sum of their nominations, others their best score; the top `limit`."""
    named = top(scores, nominate, ["question_id"], F.desc("score"), "chunk_id").groupBy("chunk_id").agg(F.sum("score").alias("named"))
    best = scores.groupBy("chunk_id").agg(F.max("score").alias("best"))
    weighed = best.join(named, "chunk_id", "left").select("chunk_id", F.coalesce("named", "best").alias("weight"))
    return weighed.orderBy(F.desc("weight"), "chunk_id").limit(limit)


def batches(df: DataFrame, by: list[str], size: int, *order: Column | str) -> DataFrame:
    """Batch numbers from 1."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(at / size) + 1)


def search(nodes: DataFrame, text: Column, query: str, limit: int, *order: str) -> DataFrame:
    """Rows whose text holds the trimmed query, case aside; the first `limit` in input order; none for a blank query."""
    q = query.strip().lower()
    hits = nodes.where(F.lower(text).contains(q)) if q else nodes.limit(0)
    return hits.orderBy(*order).limit(limit)
