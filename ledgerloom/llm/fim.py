"""Fill-in-middle: texts cut at two of their units and put together as prefix, suffix, middle or suffix, prefix, middle.

While the units of a text are counted, the byte and code-point offsets of every STEP-th of them are recorded. A cut then
searches the checkpoints and reads on from the one before it, so what is held of a text of any length is its bytes and one
checkpoint for STEP units, and no unit is read twice but the last few before a cut.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between checkpoints, and bytes that are looked at together while counting.
STEP, WINDOW = 64, 1 << 20
#: Fixed by the contract: the units, the marks, the seed of the hashes, the shares of texts in a hundred.
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CHANGED, SPM = 42, 50, 80


class Checkpoints:
    """The number of units of a UTF-8 text and the offsets of every step-th one's end."""

    def __init__(self, text: bytes, step: int = STEP, window: int = WINDOW):
        self.text, units, chars = text, 0, 0
        self.units, self.bytes, self.chars = [0], [0], [0]
        for low in range(0, len(text), window):
            part = np.frombuffer(text, np.uint8, min(window + 1, len(text) - low), low)
            blank = (part == 32) | ((part >= 9) & (part <= 13))
            own = part[:window]
            last = np.append(blank[1:], True) if low + len(own) == len(text) else blank[1:]
            ends = np.flatnonzero(~blank[: len(own)] & last)
            begun = np.cumsum((own & 0xC0) != 0x80)  # code points up to each byte
            at = ends[np.arange((-units - 1) % step, len(ends), step)]
            self.units += range(units + 1 + (-units - 1) % step, units + len(ends) + 1, step)
            self.bytes += (at + low + 1).tolist()
            self.chars += (begun[at] + chars).tolist()
            units, chars = units + len(ends), chars + int(begun[-1])
        self.n = units + (len(text) > 0 and text[-1] in b" \t\n\v\f\r")  # white space at the end is a unit of its own
        self.n_chars = chars

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first `unit` units."""
        if unit >= self.n:
            return len(self.text), self.n_chars
        i = bisect_right(self.units, unit) - 1
        at = start = self.bytes[i]
        for _ in range(unit - self.units[i]):
            at = UNIT.match(self.text, at).end()
        return at, self.chars[i] + int(np.count_nonzero(np.frombuffer(self.text, np.uint8, at - start, start) & 0xC0 != 0x80))


def hashes(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers below 2^32 of a row: the first digits of a digest of seed and id (nothing for a null id)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


def transformed(doc_id, text: bytes, changed: int = CHANGED, spm: int = SPM, seed: int = SEED) -> tuple[int, str, bytes, int | None, int | None]:
    """The units of a text, its form, the text in that form, and the code points of prefix and middle."""
    points, (h1, h2, h3, h4) = Checkpoints(text), hashes(doc_id, seed)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not text or p in text or s in text or m in text or h3 % 100 >= changed:
        return points.n, "plain", text, None, None
    low, high = sorted((h1 % (points.n + 1), h2 % (points.n + 1)))
    (a, x), (b, y) = points.cut(low), points.cut(high)
    if h4 % 100 < spm:
        return points.n, "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b])), x, y - x
    return points.n, "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b])), x, y - x


def transform(docs: DataFrame, changed: int = CHANGED, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), output (the text in that form), prefix_chars and middle_chars of every row.

    changed and spm: of a hundred texts, how many are cut, and how many of those are put as spm. Null counts as empty;
    empty texts and texts that hold a mark stay plain, with null lengths. Cuts may coincide or stand at an end: parts may be
    empty. Texts of any length are read whole; rows with equal ids are cut at the same share of their units, repeated rows
    come out alike, rows with a null id as if it had no digits; an empty table gives an empty result; extra columns of any
    name are left out. One pass, nothing is shuffled.
    """

    def each(batches):
        for batch in batches:
            rows = [transformed(i, t, changed, spm, seed) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            n, form, out, prefix, middle = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(out, pa.binary()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    schema = rows.select("doc_id", null("long", "n"), null("string", "form"), null("binary", "output"), null("long", "prefix_chars"), null("long", "middle_chars")).schema
    return rows.mapInArrow(each, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that was put in a form: the marks stand once each, so that what lies between them tells the parts."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(4), F.length(output))
        first = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(first) + 4, F.length(body))
        other = F.substring_index(rest, MIDDLE, 1)
        return first, other, F.substring(rest, F.length(other) + 4, F.length(rest))

    prefix, suffix, middle = parts(SUFFIX)
    tail, head, between = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(head, between, tail)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """transform's rows with the digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))
