"""The viewer's payload as rows of JSON: a header, then sources, nodes, edges, warnings and benchmark ids, one document each.

A node's document nests what belongs to it: the first pieces of its evidence, the first benchmark items it matches, the
first of its incident edges, and how many there are of each. All of that is one bag of parts keyed by node, which is shuffled
once and of which a ranking limit keeps the first few of each kind, so a hub's document is no larger than another's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import hub_rows, spread, written
from .views import counts

# Fields of the viewer's nodes and edges.
NODE_FIELDS = """id node_type label entity_type canonical_name normalized_label claim_role modality polarity importance assertion_level subject_ref predicate
object_text metric_ref period_ref qualifier value category reasoning_method premise_node_ids conclusion_claim_ids rationale verification status""".split()
EDGE_FIELDS = "id edge_type source_id target_id assertion_level confidence status rationale evidence extraction_origin verification".split()
SOURCE_FIELDS = "id object_type sequence text raw_text page block processing_status candidate_count irrelevant_reason".split()
#: How many pieces of evidence, benchmark items and incident edges a node's document shows.
SHOWN = {"evidence": 20, "benchmark_matches": 20, "edges": 30}


def kept(rows: DataFrame, fields: list[str]) -> list[str]:
    return [c for c in fields if c in rows.columns]


def _cut(parts: DataFrame, most: dict[str, int], *keys: str) -> DataFrame:
    """The first parts of each kind by keys, with their kind and turn. What orders them isn't shuffled, but made here from the part."""
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in SHOWN])
    text = F.coalesce(F.to_json("evidence"), *[F.col(k)["id"].cast("string") for k in ("benchmark_matches", "edges")])
    turn = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("seq", "text"))
    first = parts.withColumn("kind", kind).withColumn("text", text).withColumn("turn", turn).where(F.col("turn") <= max(most.values()))
    limit = reduce(lambda a, k: F.when(F.col("kind") == k, F.lit(most[k])).otherwise(a), SHOWN, F.lit(0))
    return first.where(F.col("turn") <= limit).drop("text")


def node_documents(nodes: DataFrame, evidence: DataFrame, matches: DataFrame, edges: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """Id and json of every node: its fields (nulls left out), evidence, benchmark_matches and edges, and n_ of each.

    evidence: node_id, seq and any columns to show; matches: object_id, item_id, description, status; edges: id, source_id,
    target_id and any of EDGE_FIELDS. Evidence is shown by seq, matches by item, edges by id; a loop counts once. Parts of
    unknown nodes are left out, of repeated node rows one is taken. What a document shows is bounded by `shown`, whatever a
    node's degree; a hub's parts are dealt to many tasks and cut to that number in each.
    """
    shown = SHOWN | (shown or {})
    own = nodes.select("id", F.struct(*kept(nodes, NODE_FIELDS)).alias("node"))
    quote = F.struct(*[c for c in evidence.columns if c not in ("node_id", "seq")])
    link = F.struct(*kept(edges, EDGE_FIELDS))
    bag = [
        evidence.select(F.col("node_id").alias("id"), F.col("seq").cast("long").alias("seq"), quote.alias("evidence")),
        matches.select(F.col("object_id").alias("id"), F.struct(F.col("item_id").alias("id"), "description", "status").alias("benchmark_matches")),
        edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), link.alias("edges")),
    ]
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bag).where("id is not null")
    totals = written(parts.groupBy("id").agg(*[F.count(k).alias(f"n_{k}") for k in SHOWN], F.count(F.lit(1)).alias("n")), "totals")
    n = spread(totals.sparkSession, totals.agg(F.sum("n")).first()[0] or 0)
    # A node's parts come together at once, but for hubs: those, which are few, are cut by shares first.
    hubs = totals.where(F.col("n") > hub_rows()).select("id", F.lit(True).alias("hub"))
    share = F.when(F.col("hub"), F.pmod(F.xxhash64("seq", *SHOWN), F.lit(n))).otherwise(0)
    near = parts.join(F.broadcast(hubs), "id", "left").select(*parts.columns, share.alias("share")).repartition(n, "id", "share")
    few = _cut(_cut(near, shown, "id", "share").select(*parts.columns).repartition(n, "id"), shown, "id")
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("turn", k)))), lambda x: x[k]).alias(k)
    nested = few.groupBy("id").agg(*[listed(k) for k in SHOWN])
    once = own.groupBy("id").agg(F.min(F.to_json("node")).alias("fields"))
    whole = once.join(totals, "id", "left").join(nested, "id", "left")
    rest = F.struct(*[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in SHOWN], *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k in SHOWN])
    return _joined(whole, rest)


def _joined(whole: DataFrame, rest: Column) -> DataFrame:
    """The JSON of a node's own fields, which are never none, and of what is nested, as one object."""
    both = whole.select("id", "fields", F.to_json(rest).alias("rest"))
    return both.select("id", F.concat(F.substring("fields", F.lit(1), F.length("fields") - 1), F.lit(","), F.substring("rest", F.lit(2), F.length("rest"))).alias("json"))


def edge_documents(edges: DataFrame, matches: DataFrame, shown: int = SHOWN["benchmark_matches"]) -> DataFrame:
    """id and json of every edge, with the first benchmark items it matches."""
    turn = F.row_number().over(Window.partitionBy("object_id").orderBy("item_id"))
    few = matches.withColumn("turn", turn).where(F.col("turn") <= shown)
    items = few.groupBy(F.col("object_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("item_id").alias("id"), "description", "status"))), lambda x: F.struct(x["id"].alias("id"), x["description"].alias("description"), x["status"].alias("status"))).alias("benchmark_matches"))
    return edges.join(items, "id", "left").select("id", F.to_json(F.struct(*kept(edges, EDGE_FIELDS), "benchmark_matches")).alias("json"))


def source_documents(sources: DataFrame) -> DataFrame:
    """id and json of every source; its text is the normalised one, or the raw one without it."""
    rows = sources.withColumn("text", F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text", F.lit(""))).withColumn("raw_text", F.coalesce("raw_text", F.lit(""))).withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    return rows.select("id", F.to_json(F.struct(*kept(rows, SOURCE_FIELDS))).alias("json"))


def header(summary: DataFrame, nodes: DataFrame, edges: DataFrame, sources: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row of JSON: summary's columns (one row: document, graph, run, coverage, validation, evaluation) and counts by type."""
    by = counts(nodes, edges).groupBy().agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "n"))))).alias(f"{k}_types") for k in ("node", "edge")])
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    total = reduce(lambda a, b: a.join(F.broadcast(b)), [one(nodes, "nodes"), one(edges, "edges"), one(sources, "sources"), one(warnings, "warnings"), by])
    numbers = F.struct("nodes", "edges", "sources", "node_types", "edge_types").alias("counts")
    return summary.join(F.broadcast(total)).select(F.to_json(F.struct(*summary.columns, numbers, F.col("warnings").alias("warning_count"))).alias("json"))


def payload(summary: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, matches: DataFrame, warnings: DataFrame) -> DataFrame:
    """Section, id and json of the whole payload: header, source, node, edge, warning and benchmark rows.

    warnings: object_id. Warning and benchmark rows are distinct ids. An empty graph gives the header alone.
    """
    part = lambda section, rows: rows.select(F.lit(section).alias("section"), "id", "json")
    ids = lambda rows, section: rows.where("object_id is not null").select(F.lit(section), F.col("object_id").cast("string"), F.lit(None).cast("string")).distinct()
    out = header(summary, nodes, edges, sources, warnings).select(F.lit("header").alias("section"), F.lit(None).cast("string").alias("id"), "json")
    out = out.union(part("source", source_documents(sources))).union(part("node", node_documents(nodes, evidence, matches, edges))).union(part("edge", edge_documents(edges, matches)))
    return out.union(ids(warnings, "warning")).union(ids(matches, "benchmark"))
