"""Names of a lexicon in texts: a trie of code points, scanned from left to right, the longest name at each place.

The lexicon may have any size: it is held by the tasks a block of fixed size at a time, and every block marks the longest of
its names at each place of each text; the marks of all blocks are then thinned to names that don't overlap. Passes follow
each other without a shuffle. A large lexicon costs a written pass over the texts for each block, after which the block's
broadcast is destroyed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..plans.rounds import drop_written, written

#: Code points of names that a task holds at once.
BLOCK_CHARS = 4 << 20
HIT = "struct<start:int,end:int,name:string>"
_END = ""


class _Fold(dict):
    """Code points without their case, if that is one code point as well; for str.translate."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = found = ord(low) if len(low) == 1 else code
        return found


_FOLD = _Fold()


class Trie:
    """Names by their code points, case aside; of names that differ in case only, the smallest is given."""

    def __init__(self, names: Iterable[str]):
        self.root: dict = {}
        for name in sorted(names, reverse=True):
            node = self.root
            for c in name.translate(_FOLD):
                node = node.setdefault(c, {})
            if name:
                node[_END] = name

    def marks(self, text: str, apart: bool = False) -> Iterator[tuple[int, int, str]]:
        """(start, end, name) of the longest name at every place that begins one; apart: from each on to the next behind it."""
        low, root, n, start = text.translate(_FOLD), self.root, len(text), 0
        while start < n:
            node, at, end, name = root.get(low[start]), start + 1, 0, ""
            while node is not None:
                if _END in node:
                    end, name = at, node[_END]
                if at == n:
                    break
                node = node.get(low[at])
                at += 1
            if end:
                yield start, end, name
            start = end if end and apart else start + 1


def thinned(marks: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Marks that don't overlap: from left to right, at each place the longest, of equally long ones the smallest name."""
    out: list[tuple[int, int, str]] = []
    for mark in sorted(marks, key=lambda m: (m[0], -m[1], m[2])):
        if not out or mark[0] >= out[-1][1]:
            out.append(mark)
    return out


def _blocks(lexicon: DataFrame, most: int) -> list[DataFrame]:
    """The distinct names in blocks of about `most` code points, told apart by hash."""
    names = lexicon.select("name").where("name <> ''").distinct()
    n = max(1, -(-(names.agg(F.sum(F.length("name"))).first()[0] or 0) // most))
    if n == 1:
        return [names]
    held = written(names.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")), "lexicon", by="block")
    return [held.where(F.col("block") == b).select("name") for b in range(n)]


def occurrences(texts: DataFrame, column: str, lexicon: DataFrame, out: str = "found", most: int = BLOCK_CHARS) -> DataFrame:
    """Texts with the names in a column as an array of start, end (code points, end exclusive) and name.

    Leftmost first, the longest at each place, none overlapping; case aside, spelt as in the lexicon (column name). A null
    text has none; empty and null names are left out; names may overlap and repeat; an empty lexicon finds nothing. Columns
    of texts stay, whatever their names, but for one named like `out`, which is replaced.
    """
    spark, rows = texts.sparkSession, texts.select(F.struct(*[c for c in texts.columns if c != out]).alias("row"), F.col(column).alias("text"), F.array().cast(f"array<{HIT}>").alias("found"))
    blocks = _blocks(lexicon, most)
    only = len(blocks) == 1
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        held = spark.sparkContext.broadcast(block.toArrow().column("name").to_pylist())  # `most` code points, or so

        def each(batches, held=held, last=last):
            trie = Trie(held.value)
            for batch in slices(batches):
                made = []
                for text, before in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                    marks = [(m["start"], m["end"], m["name"]) for m in before] + list(trie.marks(text or "", only))
                    made.append([{"start": s, "end": e, "name": n} for s, e, n in (thinned(marks) if last and not only else marks)])
                at = batch.schema.get_field_index("found")
                yield batch.set_column(at, "found", pa.array(made, batch.schema.field(at).type))

        marked = rows.mapInArrow(each, rows.schema)
        if not last:
            before, marked = rows, written(marked, "marks")
            held.destroy()
            if i:
                drop_written(before)
        rows = marked
    return rows.select("row.*", F.col("found").alias(out))


def segments(text: Column | str, found: Column | str) -> Column:
    """An array of name, quote (from the name to the next one or the end) and rest (the quote without the name)."""
    text, found = (F.col(c) if isinstance(c, str) else c for c in (text, found))
    nexts = F.concat(F.transform(F.slice(found, F.lit(2), F.size(found)), lambda m: m["start"]), F.array(F.length(text)))
    part = lambda a, b: F.substring(text, a + 1, b - a)
    return F.when(F.size(found) > 0, F.zip_with(found, nexts, lambda m, to: F.struct(m["name"].alias("name"), part(m["start"], to).alias("quote"), part(m["end"], to).alias("rest"))))
