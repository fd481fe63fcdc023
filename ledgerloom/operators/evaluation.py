"""Recall against a gold inventory: term specifications matched with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact
from ..plans.rounds import appended
from .validation import ratio

SPEC_BLOCK = 500


def _all(text: Column, words: Column) -> Column:
    return words.isNull() | F.forall(words, text.contains)


def _any(text: Column, words: Column) -> Column:
    return words.isNull() | F.exists(words, text.contains)


def _is(text: Column, words: Column) -> Column:
    return words.isNull() | F.exists(words, lambda w: text == w)


def _packed(specs: DataFrame) -> DataFrame:
    """The specifications with the white space and case of their terms taken off, once."""
    terms = {c: F.transform(c, compact) for c, t in specs.dtypes if t == "array<string>" and c != "node_types"}
    groups = {c: F.transform(c, lambda g: F.transform(g, compact)) for c, t in specs.dtypes if t == "array<array<string>>"}
    return specs.withColumns(terms | groups)


def labelled_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (id, node_type, label, object_text, predicate, subject_ref, metric_ref, period_ref, ...) with text and labels.

    subject, metric and period are the labels of the nodes that the references name; text is all that `match_nodes` reads.
    """
    out, labels = nodes, nodes.select("id", "label")
    for c in ("subject", "metric", "period"):
        out = out.join(labels.select(F.col("id").alias(f"{c}_ref"), F.col("label").alias(c)), f"{c}_ref", "left")
    return out.withColumn("text", F.concat_ws(" ", "label", "object_text", "predicate", "subject", "metric", "period"))


def data_points(labelled: DataFrame) -> DataFrame:
    """The points that `match_data` reads, of labelled_nodes' rows with value (raw, scale)."""
    return labelled.where("node_type = 'DataPoint'").select("id", "subject", "metric", "period", F.col("value.raw").alias("raw"), F.col("value.scale").alias("point_scale"))


def _matched(nodes: DataFrame, specs: DataFrame, condition: Column) -> DataFrame:
    """Specifications in blocks of a fixed size against all nodes; a row per spec with the ids that match."""
    blocks, specs = max(1, -(-specs.count() // SPEC_BLOCK)), _packed(specs)
    part = lambda held: nodes.join(F.broadcast(held), condition).select("spec_id", "id")
    if blocks == 1:
        return part(specs)
    return appended((part(specs.where(F.pmod(F.xxhash64("spec_id"), F.lit(blocks)) == b)) for b in range(blocks)), "matched")


def match_nodes(nodes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, id). nodes: id, node_type, text; specs: node_types, all_terms, any_term_groups (arrays, null if absent)."""
    rows = nodes.withColumn("packed", compact("text"))
    groups = F.col("any_term_groups").isNull() | F.forall("any_term_groups", lambda g: _any(F.col("packed"), g))
    kinds = F.col("node_types").isNull() | F.array_contains("node_types", F.col("node_type"))
    return _matched(rows, specs, kinds & _all(F.col("packed"), F.col("all_terms")) & groups)


def match_data(points: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, id). points: id, subject, metric, period, raw, point_scale."""
    rows = points.select("id", *[compact(c).alias(f"_{c}") for c in ("subject", "metric", "period", "raw")], F.col("point_scale").cast("string").alias("point_scale"))
    return _matched(rows, specs, _all(F.col("_subject"), F.col("subject_terms")) & _any(F.col("_subject"), F.col("subject_any")) & _is(F.col("_metric"), F.col("metric_any")) & _all(F.col("_metric"), F.col("metric_terms")) & _is(F.col("_period"), F.col("period_any")) & _is(F.col("_raw"), F.col("raw_any")) & (F.col("scale").isNull() | (F.col("scale") == F.col("point_scale"))))


def match_relations(edges: DataFrame, sources: DataFrame, targets: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, id) of active edges from a matched source to a matched target with a type of the spec."""
    s, t = sources.select("spec_id", F.col("id").alias("source_id")), targets.select("spec_id", F.col("id").alias("target_id"))
    live = edges.where("status = 'active'").join(s, "source_id").join(t, ["spec_id", "target_id"]).join(specs.select("spec_id", "edge_types"), "spec_id")
    return live.where(F.array_contains("edge_types", F.col("edge_type"))).select("spec_id", "id")


def verdicts(specs: DataFrame, matches: DataFrame) -> DataFrame:
    """PASS or MISS of each spec with its number of matches."""
    n = matches.groupBy("spec_id").agg(F.count_distinct("id").alias("matches"))
    joined = specs.join(n, "spec_id", "left")
    return joined.select(*[c for c in ("spec_id", "category") if c in specs.columns], F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") > 0, "PASS").otherwise("MISS").alias("status"))


def recall(results: DataFrame, category: str = "category") -> DataFrame:
    """Passed, total and recall of each category."""
    passed, total = F.count_if(F.col("status") == "PASS"), F.count(F.lit(1))
    return results.groupBy(category).agg(passed.alias("passed"), total.alias("total"), ratio(passed, total).alias("recall"))
