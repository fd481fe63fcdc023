"""JSON of changing shape as VARIANT: what stands in prose, what kind a value is, texts of messages, entries of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: What a text falls into from an opening bracket on: strings, brackets, the rest, a quote that doesn't end.
_TOKEN = r'"(?:[^"\\]|\\.)*+"|[\[\]{}]|[^"\[\]{}]++|"'


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unfenced(x: Column | str) -> Column:
    """A text without the fence around all of it."""
    text = strip(x)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(?s)```(?:(?!```).)*$", "")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def _balanced(text: Column) -> Column:
    """The beginning of a text up to where its first bracket closes; null if it never does."""
    return _let(text, _closed)


def _closed(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def add(acc, token):
        depth = acc["depth"] + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        moved = F.struct(depth.alias("depth"), (acc["length"] + F.length(token)).alias("length"), (depth <= 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(moved)

    return F.aggregate(tokens, start, add, lambda acc: F.when(acc["done"], F.substring(text, F.lit(1), acc["length"])))


def first_json(x: Column | str) -> Column:
    """The JSON text of an answer: all of it without its fence, else the first value in braces or brackets that decodes.

    Null if nothing does, and for null. Brackets inside strings don't count; one that doesn't decode is passed over, and the
    search goes on at the next one, inside it as well.
    """

    def places(text: Column) -> Column:
        steps = F.regexp_extract_all(text, F.lit(r"[^\[{]*+[\[{]"), F.lit(0))
        add = lambda acc, step: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(step))
        return F.aggregate(steps, F.array().cast("array<int>"), add)

    def look(text: Column) -> Column:
        try_at = lambda i: _let(_balanced(F.substring(text, i, F.length(text))), lambda part: F.when(F.try_parse_json(part).isNotNull(), part))
        first = F.aggregate(places(text), F.lit(None).cast("string"), lambda found, i: F.when(found.isNotNull(), found).otherwise(try_at(i)))
        return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(first)

    return _let(unfenced(x), look)


def kind(v: Column | str) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (a JSON null) or NUMBER of a variant; null for none."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), name).when(name.isNotNull(), "NUMBER")


def string(v: Column, path: str = "$") -> Column:
    """The string at a path; null if something else stands there, numbers included."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def array(v: Column, path: str = "$") -> Column:
    """The elements of the list at a path; null if something else stands there."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def content_text(v: Column | str) -> Column:
    """A plain string, {text}, or {parts}, whose strings, texts and image pointers stand apart by a blank line; else empty."""

    def part(p: Column) -> Column:
        pointer = F.concat(F.lit("[Image attachment: "), F.coalesce(F.try_variant_get(p, "$.asset_pointer", "string"), F.lit("attachment")), F.lit("]"))
        return F.coalesce(string(p), string(p, "$.text"), F.when(string(p, "$.content_type") == "image_asset_pointer", pointer), F.lit(""))

    def whole(v: Column) -> Column:
        parts = F.filter(F.transform(array(v, "$.parts"), part), lambda t: t != "")
        return F.coalesce(string(v), strip(F.array_join(parts, "\n\n")), string(v, "$.text"), F.lit(""))

    return F.coalesce(_let(_c(v), whole), F.lit(""))


def entries(rows: DataFrame, column: str, depth: int = 1) -> DataFrame:
    """Rows with path, kind and scalar (its text; null for containers) of every entry of the variants in a column.

    `depth` levels of lists and dicts are opened, one after another, each by a lateral variant_explode; entries of a list
    are named by their place. A scalar or null has no entries.
    """
    spark, rest = rows.sparkSession, [c for c in rows.columns if c != column]
    level = rows.select(*rest, F.col(column).alias("__v"), F.lit("$").alias("path"))
    out = None
    for _ in range(depth):
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select(*rest, F.col("value").alias("__v"), F.concat("path", name).alias("path"))
        out = level if out is None else out.union(level)
    v, k = F.col("__v"), kind("__v")
    return out.select(*rest, "path", k.alias("kind"), F.when(~k.isin("OBJECT", "ARRAY"), F.try_variant_get(v, "$", "string")).alias("scalar"))
