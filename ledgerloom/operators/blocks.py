"""Greedy folds: blocks, views, chunks. Each works on one row's text or array, so none of them shuffles."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.text import LEGAL_MARKERS, LOOSE_NUMBER, NORM_STEPS, strip


def fold_lines(lines: Column, most: int) -> Column:
    """Array of blocks of lines joined by line feeds, each as long as fits into `most` characters; a longer line stays whole."""
    shape = "struct<done:array<string>,now:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now")).cast(shape)

    def add(acc, line):
        fits = F.length(acc["now"]) + 1 + F.length(line) <= most
        done = F.when(acc["now"].isNotNull() & ~fits, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(acc["now"].isNull() | ~fits, line).otherwise(F.concat(acc["now"], F.lit("\n"), line))
        return F.struct(done.alias("done"), now.alias("now")).cast(shape)

    return F.aggregate(lines, start, add, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


_STEPS = tuple((re.compile(p), by) for p, by in NORM_STEPS)
_GAP, _LOOSE = re.compile(r"\n\s*\n"), re.compile(LOOSE_NUMBER)
_LEGAL, _FIGURE = re.compile("|".join(LEGAL_MARKERS)), re.compile(r"(?:图表|图)\s*\d+")


def normalised(text: str) -> str:
    """T01 of one string, as `norm_text` of a column."""
    for pattern, by in _STEPS:
        text = pattern.sub(by, text)
    return text.strip()


def kind_of(text: str) -> str:
    """T14 of one normalised string, as `object_type` of a column."""
    if _LEGAL.search(text):
        return "legal"
    if _FIGURE.match(text):
        return "figure_caption"
    lines = [s for s in text.splitlines() if s.strip()]
    loaded = sum(len(_LOOSE.findall(s)) >= 2 for s in lines)
    return "table_like" if len(lines) >= 2 and loaded >= max(1, len(lines) // 3) else "paragraph"


def page_blocks(page: str, most: int) -> Iterator[tuple[str, str, int | None]]:
    """(raw, normalised, start) of a page's blocks: groups between blank lines, their lines packed up to `most` characters.

    start is where the block's first line is found from the end of the last found block on; none if it isn't.
    """
    cursor = 0
    for group in _GAP.split(page):
        packs: list[list[str]] = []
        for line in filter(None, map(str.rstrip, group.splitlines())):
            if packs and sum(map(len, packs[-1])) + len(packs[-1]) + len(line) <= most:
                packs[-1].append(line)
            else:
                packs.append([line])
        for pack in packs:
            raw = "\n".join(pack).strip()
            if text := normalised(raw):
                found = page.find(raw.partition("\n")[0], cursor)
                if found >= 0:
                    cursor = found + len(raw)
                yield raw, text, found if found >= 0 else None


def source_blocks(pages: DataFrame, most: int = 2800) -> DataFrame:
    """Pages (doc_id, page, text) to citeable blocks.

    Columns: block (from 1 in its page), block_id, object_type, raw_text, normalized_text, sha256 (of the raw text),
    char_start and char_end (null if the block isn't found in the page). Texts are worked on page by page in parts of Arrow batches.
    """

    def each(batches):
        for batch in slices(batches):
            rows = []
            for i, (page, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for n, (raw, norm, start) in enumerate(page_blocks(text or "", most), 1):
                    end = None if start is None else start + len(raw)
                    rows.append((i, n, f"SO_P{page or 0:03d}_B{n:03d}", kind_of(norm), raw, norm, hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest(), start, end))
            if rows:
                at, *cols = zip(*rows, strict=True)
                keys = batch.select([0, 1]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    kinds = [pa.int32(), *[pa.string()] * 5, pa.int32(), pa.int32()]
    names = ["doc_id", "page", "block", "block_id", "object_type", "raw_text", "normalized_text", "sha256", "char_start", "char_end"]
    picked = pages.select("doc_id", "page", "text")
    ddl = ["int", *["string"] * 5, "int", "int"]
    schema = picked.select("doc_id", "page", *[F.lit(None).cast(t).alias(n) for n, t in zip(names[2:], ddl, strict=True)]).schema
    return picked.mapInArrow(each, schema)


def sequenced(blocks: DataFrame) -> DataFrame:
    """Blocks with their place (sequence, from 1) in the document."""
    return blocks.withColumn("sequence", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")))


def extraction_views(blocks: DataFrame, most: int = 2400) -> DataFrame:
    """A row per view of a block (view, views, text)."""
    views = fold_lines(F.split("normalized_text", "\n"), most)
    return blocks.select("*", F.size(views).alias("views"), F.posexplode(views).alias("v", "view_text")).withColumn("view", F.col("v") + 1).drop("v")


def pack_chunks(blocks: DataFrame, key: str, order: str, size: str, most: int = 9000, overhead: int = 100, identity: str | None = None) -> DataFrame:
    """`chunk` numbers for the blocks of each key, in order: greedy up to `most`, no identity twice in a chunk."""
    who = F.col(identity) if identity else F.col(order)
    items = F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), (F.col(size) + overhead).cast("long").alias("n"), who.cast("string").alias("id"))))
    shape = "struct<c:long,used:long,ids:array<string>,out:array<struct<o:long,chunk:long,id:string>>>"
    start = F.struct(F.lit(1).alias("c"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<struct<o:long,chunk:long,id:string>>").alias("out")).cast(shape)

    def add(acc, x):
        full = (F.size(acc["ids"]) > 0) & ((acc["used"] + x["n"] > most) | F.array_contains(acc["ids"], x["id"]))
        c = F.when(full, acc["c"] + 1).otherwise(acc["c"])
        one = F.array(F.struct(x["o"].alias("o"), c.alias("chunk"), x["id"].alias("id")))
        return F.struct(c.alias("c"), F.when(full, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.when(full, F.array(x["id"])).otherwise(F.concat(acc["ids"], F.array(x["id"]))).alias("ids"), F.concat(acc["out"], one).alias("out")).cast(shape)

    folded = F.aggregate(items, start, add, lambda acc: acc["out"])
    return blocks.groupBy(key).agg(folded.alias("x")).select(key, F.inline("x"))


def text_chunks(docs: DataFrame, size: int = 2600) -> DataFrame:
    """Stripped non-empty lines, over-long ones cut hard, packed greedily."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda s: s != "")
    cut = F.flatten(F.transform(lines, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size)))))
    return docs.select("doc_id", F.posexplode(fold_lines(cut, size)).alias("chunk", "chunk_text"))


def render_chunk(blocks: DataFrame, *keys: str) -> DataFrame:
    """The text of a chunk, each block under its header."""
    header = F.format_string("[SOURCE_OBJECT id=%s page=%d type=%s]\n%s", F.col("block_id"), F.col("page"), F.col("object_type"), F.col("normalized_text"))
    rows = F.sort_array(F.collect_list(F.struct("page", "block", header.alias("t"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("rendered"))
