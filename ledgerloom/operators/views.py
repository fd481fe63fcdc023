"""Browsing: modes, labels, inspection, the viewer's payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from .graph import neighbourhood

#: Seeds, depth and edge types of the viewer's modes: fixed values.
MODES = {
    "thesis": ("node_type = 'Claim' and importance = 'core'", 2, ("SUPPORTS", "CAUSES", "DEPENDS_ON", "HAS_DATA", "PREMISE_OF", "CONCLUDES")),
    "data": ("node_type = 'DataPoint' and benchmarked", 1, ("HAS_DATA", "SUPPORTS", "MEASURES", "VALID_DURING", "ABOUT")),
}
LABELS = {"thesis": (12, 5, 3), "data": (16, 5), "full": (8, 6)}


def mode(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a mode and the edges among them."""
    if name == "full":
        ids, among = nodes.select("id"), edges
    else:
        seeds, depth, types = MODES[name]
        among = edges.where(F.col("edge_type").isin(*types))
        ids = neighbourhood(among, nodes.where(seeds).select("id"), depth).select("id")
    inside = among.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def label_ranks(nodes: DataFrame, bucket: str, degree: str, order: str, most: int) -> DataFrame:
    """The nodes of each bucket that are labelled: highest degree first."""
    n = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc(degree), order))
    return nodes.withColumn("rank", n).where(F.col("rank") <= most)


def layout_order(nodes: DataFrame) -> DataFrame:
    """Nodes with their place (from 1) among those of their type: core ones first, then supporting ones, then by hash of id."""
    rank = F.when(F.col("importance") == "core", 0).when(F.col("importance") == "supporting", 1).otherwise(2)
    turn = F.row_number().over(Window.partitionBy("node_type").orderBy(rank, fnv1a("id"), "id"))
    return nodes.withColumn("place", turn)


def node_evidence(own: DataFrame, edge_evidence: DataFrame) -> DataFrame:
    """Evidence of a node and of its incident edges, once per source and quote."""
    return own.unionByName(edge_evidence).dropDuplicates(["node_id", "source_id", "quote"])


def nodes_of_sources(evidence: DataFrame) -> DataFrame:
    """The distinct (source_id, node_id) pairs with each node's place among its source's, instead of one list a source."""
    pairs = evidence.select("source_id", "node_id").distinct()
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("node_id")))


def page_source(sources: DataFrame) -> DataFrame:
    """The source shown for each page: the first opaque one, else the one with most candidates."""
    order = Window.partitionBy("page").orderBy(F.desc(F.col("processing_status") == "OPAQUE"), F.when(F.col("processing_status") == "OPAQUE", 0).otherwise(-F.col("candidate_count")), "sequence")
    return sources.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def with_benchmarks(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Nodes with the sorted ids of the benchmark items they match."""
    items = matches.groupBy("id").agg(F.sort_array(F.collect_set("spec_id")).alias("benchmark_items"))
    return nodes.join(items, "id", "left").withColumn("benchmark_items", F.coalesce("benchmark_items", F.array().cast("array<string>")))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kind (node or edge), name (its type) and n."""
    count = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node", "node_type").union(count(edges, "edge", "edge_type"))


def compact_json(rows: DataFrame, keep: list[str], key: str = "id") -> DataFrame:
    """Whitelisted fields as JSON, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*[c for c in keep if c in rows.columns])).alias("json"))


def compact_semantic(nodes: DataFrame) -> DataFrame:
    """Claims and events with their first two pieces of evidence."""
    return nodes.where("node_type in ('Claim', 'Event')").select("id", "node_type", "label", F.slice("evidence", 1, 2).alias("evidence"))


def cross_targets(claims: DataFrame, roles: list[str], size: int = 4) -> DataFrame:
    """Core claims of analytical roles and the remaining risks, or all claims if there are none, in batches."""
    chosen = claims.where((F.col("importance") == "core") & F.col("claim_role").isin(*roles) | (F.col("claim_role") == "risk"))
    rest = claims.join(chosen.groupBy("graph_id").count().select("graph_id"), "graph_id", "left_anti")
    n = F.row_number().over(Window.partitionBy("graph_id").orderBy("seq", "id")) - 1
    return chosen.unionByName(rest).withColumn("batch", F.floor(n / size) + 1)


def proposals_ok(proposals: DataFrame, nodes: DataFrame, targets: DataFrame, types: list[str]) -> DataFrame:
    """Proposals with known ends, a target of the batch, no loop, an allowed type and a confidence; once per key."""
    ids = nodes.select("id")
    good = proposals.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(targets.select(F.col("id").alias("target_id"), "batch"), ["target_id", "batch"], "left_semi")
    good = good.where(F.col("relation_type").isin(*types) & (F.col("source_id") != F.col("target_id")) & F.col("confidence").between(0, 1))
    n = F.row_number().over(Window.partitionBy("source_id", "relation_type", "target_id").orderBy("batch", "proposal_id"))
    return good.withColumn("n", n).where("n = 1").drop("n")
