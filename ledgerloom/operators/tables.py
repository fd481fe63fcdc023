"""Deterministic expansion of period tables and capacity rows into data points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import METRIC_NAMES, PERIOD, TABLE_NUMBER, sha256, stable_id, strip
from ..functions.values import DECIMAL, table_unit
from ..plans.rounds import partitions
from .lexicon import occurrences, segments

PERIODS = 5
#: Points of a block, about, by which `capacity` sets its number of partitions.
POINTS = 4
#: Fixed patterns of a capacity row and of a change of capacity.
ROW = r"(?i)^(iPhone\s+\S+)\s+(20\d{2}\.\d{2})\s+(\d+GB)\s+(\d+GB)(?:\s+.*)?$"
CHANGE = r"(?i)(内存容量|存储容量)\s*[：:]\s*从\s*(\d+GB)\s*向\s*(\d+GB)\s*升级"


def metric_names(spark: SparkSession) -> DataFrame:
    """The built-in lexicon of metrics."""
    return spark.createDataFrame([(n,) for n in METRIC_NAMES], "name string")


def periodic(blocks: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Blocks (doc_id, page, sequence, object_type, text) to points: metric, period, raw, number, qualifier, unit, currency, scale, quote.

    A line of five or more periods heads its page from its block on, until another one; each metric name of a line takes
    the numbers up to the next name, if there is one for every period. lexicon: names of metrics (`metric_names` without
    one), of any number; a metric is spelt as there.
    """
    lines = F.split("text", "\n")
    header = F.element_at(F.filter(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(PERIOD), F.lit(0))), lambda p: F.size(p) >= PERIODS), 1)
    fit = blocks.where(F.col("object_type").isin("table_like", "paragraph"))
    found = F.when(F.size(F.filter(F.transform(lines, lambda s: F.regexp_count(s, F.lit(PERIOD))), lambda n: n >= PERIODS)) > 0, F.slice(header, 1, PERIODS))
    order = Window.partitionBy("doc_id", "page").orderBy("sequence")
    headed = fit.withColumn("periods", F.last(found, True).over(order)).where("periods is not null")
    rows = headed.select("doc_id", "page", "sequence", "periods", F.explode(lines).alias("line"))
    named = occurrences(rows, "line", lexicon if lexicon is not None else metric_names(blocks.sparkSession))
    cells = named.select("*", F.explode(segments("line", "found")).alias("p"))
    cells = cells.select("doc_id", "page", "sequence", "periods", F.col("p.name").alias("metric"), strip("p.quote").alias("quote"), F.regexp_extract_all("p.rest", F.lit(TABLE_NUMBER), F.lit(0)).alias("raws"))
    cells = cells.where(F.size("raws") >= F.size("periods")).withColumn("raws", F.slice("raws", F.lit(1), F.size("periods"))).withColumn("u", table_unit("metric", "raws"))
    points = cells.select("doc_id", "page", "sequence", "metric", "quote", "u.*", F.explode(F.arrays_zip("periods", "raws")).alias("x"))
    number = _plain("x.raws").try_cast(DECIMAL)
    return points.select("doc_id", "page", "sequence", "metric", F.col("x.periods").alias("period"), F.col("x.raws").alias("raw"), number.alias("number"), F.when(F.col("x.periods").endswith("E"), "forecast").otherwise("actual").alias("qualifier"), "unit", "currency", "scale", "quote").distinct()


def _plain(raw: str) -> Column:
    """A cell's number as text: no grouping commas, no percent sign, no plus."""
    return F.regexp_replace(F.replace(F.regexp_replace(raw, "%$", ""), F.lit(","), F.lit("")), r"^\+", "")


def periodic_nodes(points: DataFrame, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of `periodic` as (nodes, evidence); issuers: doc_id, issuer.

    A point that stands in several lines is one node (id, node_type, label, subject_ref, metric_ref, period_ref, qualifier,
    value, mentions) with a row of evidence (node_id, doc_id, page, sequence, quote, quote_sha256) for each block and quote.
    A document without an issuer has points without a subject.
    """
    low = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    subject = F.when(F.col("issuer").isNotNull(), stable_id("ENT", F.lit("company"), low("issuer")))
    rows = points.join(issuers, "doc_id", "left").withColumns({"subject_ref": subject, "metric_ref": stable_id("MET", low("metric")), "period_ref": stable_id("PER", low("period")), "plain": _plain("raw")})
    none = F.lit(None).cast("string")
    rows = rows.withColumn("id", stable_id("DATA", "subject_ref", "metric_ref", "period_ref", F.lit("scalar"), "raw", "plain", none, none, "qualifier")).withColumn("quote_sha256", sha256("quote"))
    value = F.struct(F.lit("scalar").alias("kind"), "raw", F.col("plain").alias("normalized_decimal"), none.alias("range_low"), none.alias("range_high"), "unit", "currency", "scale")
    label = F.concat("metric", F.lit(" "), "period", F.lit(" = "), "raw")
    node = F.struct(F.lit("DataPoint").alias("node_type"), label.alias("label"), "subject_ref", "metric_ref", "period_ref", "qualifier", value.alias("value"))
    proof = ["doc_id", "page", "sequence", "quote_sha256"]
    nodes = rows.groupBy("id").agg(F.min_by(node, F.struct("doc_id", "page", "sequence", "quote")).alias("n"), F.count_distinct(*proof).alias("mentions")).select("id", "n.*", "mentions")
    return nodes, rows.select(F.col("id").alias("node_id"), "doc_id", "page", "sequence", "quote", "quote_sha256").distinct()


def capacity(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, sequence, text) to points: subject, metric, period, raw, number, endpoint, mentions.

    A row's line gives its reported memory and storage; each change of capacity in the same line gives the point before it
    and the point after it, of the same subject and period. A point named several times keeps its first endpoint; mentions
    counts its distinct lines by block, told apart before points come together, since a document's lines may be many.
    """
    rows = blocks.select("doc_id", "sequence", F.posexplode(F.transform(F.split("text", "\n"), strip)).alias("n", "line")).where(F.col("line").rlike(ROW))
    part = lambda i: F.regexp_extract("line", ROW, i)
    point = lambda metric, raw, endpoint: F.struct(metric.alias("metric"), raw.alias("raw"), F.lit(endpoint).alias("endpoint"))
    own = F.array(point(F.lit("内存容量"), part(3), "reported"), point(F.lit("存储容量"), part(4), "reported"))
    change = lambda c, i: F.regexp_extract(c, CHANGE, i)
    moved = F.flatten(F.transform(F.regexp_extract_all("line", F.lit(CHANGE), F.lit(0)), lambda c: F.array(point(change(c, 1), change(c, 2), "before"), point(change(c, 1), change(c, 3), "after"))))
    points = rows.select("doc_id", "sequence", "n", "line", part(1).alias("subject"), part(2).alias("period"), F.posexplode(F.concat(own, moved)).alias("i", "x")).select("*", "x.*")
    first = F.min(F.struct("sequence", "n", "i", "endpoint")).alias("first")
    n, key = partitions(blocks, POINTS), ["doc_id", "subject", "metric", "period", "raw"]
    lines = points.repartition(n, "doc_id", "line").groupBy(*key, "sequence", "line").agg(first)
    out = lines.repartition(n, *key).groupBy(*key).agg(F.min("first").getField("endpoint").alias("endpoint"), F.count("sequence").alias("mentions"))
    return out.withColumn("number", F.regexp_extract("raw", r"\d+", 0).cast("long"))
