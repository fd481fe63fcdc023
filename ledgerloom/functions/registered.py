"""The engine's functions for SQL text: `register(spark)` makes them temporary functions of a session.

Scalars and text_chunks are SQL functions, so the optimiser sees through them and they run as the built-in expressions that
they are made of; source_blocks, whose offsets follow a cursor, is a Python table function that reads a page a call.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.blocks import kind_of, page_blocks
from .text import NORM_STEPS, NUMBER, WORD_NUMBER

_BLOCK = "block int, block_id string, object_type string, raw_text string, normalized_text string, sha256 string, char_start int, char_end int"


def _raw(pattern: str) -> str:
    """A pattern as a raw literal of SQL."""
    return f"r'{pattern}'"


def _text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, r'(?U)^\\s+|\\s+$', '')"


def _norm(x: str) -> str:
    for pattern, by in NORM_STEPS:
        x = f"regexp_replace({x}, {_raw(pattern) if chr(10) not in pattern else _text(pattern)}, {_text(by)})"
    return _strip(x)


def _terms(x: str) -> str:
    grams = f"filter(regexp_extract_all({x}, '[一-鿿]+', 0), r -> length(r) >= 2)"
    grams = f"flatten(transform({grams}, r -> transform(sequence(1, length(r) - 1), i -> substring(r, i, 2))))"
    return f"array_distinct(concat({grams}, regexp_extract_all(lower({x}), '[a-zA-Z][a-zA-Z0-9_]+', 0)))"


_SCORE = f"""(aggregate(filter(terms, t -> length(t) >= 2), 0L, (a, t) -> a + (length(t) + 3) * least(floor((length(x) - length(replace(lower(x), lower(t), ''))) / length(t)), 4))
  + 0.3D * size(array_intersect({_terms("x")}, array_distinct(flatten(transform(terms, t -> {_terms("t")}))))))
  * if(length(x) - length(replace(x, '.', '')) > 30 and contains(x, '目录'), 0.1D, 1D)"""
_LINES = f"filter(transform(split(x, '\\n'), s -> {_strip('s')}), s -> s <> '')"
_CUT = f"flatten(transform({_LINES}, s -> transform(sequence(0, cast(floor((length(s) - 1) / most) as int)), i -> substring(s, i * most + 1, most))))"
_PACKED = f"""aggregate({_CUT}, cast(array() as array<string>), (a, s) -> if(size(a) > 0 and length(element_at(a, -1)) + 1 + length(s) <= most,
  concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), '\\n', s))), concat(a, array(s))))"""

#: Functions by signature: what they return and how.
FUNCTIONS = {
    "norm_text(x STRING)": ("STRING", _norm("x")),
    "stable_id(prefix STRING, parts ARRAY<STRING>)": ("STRING", f"concat(prefix, '_', upper(substring(sha2(array_join(transform(parts, p -> {_strip("coalesce(p, 'None')")}), chr(31)), 256), 1, 16)))"),
    "number_tokens(x STRING)": ("ARRAY<STRING>", f"array_distinct(transform(regexp_extract_all(x, {_raw(WORD_NUMBER)}, 0), n -> replace(n, ',', '')))"),
    "number_literals(x STRING)": ("ARRAY<STRING>", f"regexp_extract_all(x, {_raw(NUMBER)}, 0)"),
    "text_terms(x STRING)": ("ARRAY<STRING>", _terms("x")),
    "relevance_score(x STRING, terms ARRAY<STRING>)": ("DOUBLE", _SCORE),
}
TABLES = {"text_chunks(x STRING, most INT)": ("chunk INT, chunk_text STRING", f"SELECT posexplode({_PACKED})")}


@udtf(returnType=_BLOCK)
class SourceBlocks:
    """source_blocks(page, text, most): C01 of one page."""

    def eval(self, page: int, text: str, most: int):
        for n, (raw, norm, start) in enumerate(page_blocks(text or "", most), 1):
            end = None if start is None else start + len(raw)
            yield n, f"SO_P{page or 0:03d}_B{n:03d}", kind_of(norm), raw, norm, hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest(), start, end


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL text of this session; a second time replaces them.

    norm_text, stable_id, number_tokens, number_literals, text_terms and relevance_score are for any expression;
    text_chunks(text, most) and source_blocks(page, text, most) stand after LATERAL. A null text gives null, or no row.
    """
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for signature, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE({columns}) RETURN {body}")
    spark.udtf.register("source_blocks", SourceBlocks)
