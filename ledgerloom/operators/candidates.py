"""Candidates of extraction chunks to nodes, evidence, edges, proposals and rejections, as joins and aggregates.

Everything that a loop would look up in the graph built so far is an aggregate here: the first writer of a node is the
one with the smallest seq, the last writer of a local id the one with the largest, and edges are distinct by their key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..plans.rounds import written
from .graph import ARGUMENT_TYPES

# Fixed vocabularies.
KINDS = ("entity", "data_point", "event", "claim")
ENTITY_TYPES = ("company", "product", "industry", "region", "institution", "other")
CLAIM_ROLES = ("observation", "forecast", "interpretation", "valuation", "recommendation", "risk", "guidance")
MODALITIES = ("actual", "forecast", "opinion", "recommendation", "risk", "conditional")
RELATION_TYPES = (*ARGUMENT_TYPES, "ASSUMES", "SAME_AS", "HAS_DATA")
#: Qualifiers whose points are about the issuer if they name no subject.
ISSUER_QUALIFIERS = ("actual", "forecast", "assumption")
UNLABELLED = "metric or period missing"

_EVIDENCE = "evidence array<struct<source_object_id:string,quote:string>>"
VALUE = "struct<kind:string,raw:string,normalized_decimal:string,range_low:string,range_high:string,unit:string,currency:string,scale:string>"
#: seq is unique and gives the order of arrival; a column that a kind doesn't use is null.
CANDIDATE = f"seq long, chunk_id string, kind string, local_id string, name string, entity_type string, text string, category string, subject_name string, metric_name string, period_label string, qualifier string, issuer string, value {VALUE}, claim_role string, modality string, polarity string, importance string, predicate string, object_text string, data_point_local_ids array<string>, {_EVIDENCE}"
#: confidence is JSON text, so that strings and booleans aren't taken for numbers.
RELATION = f"seq long, chunk_id string, source_local_id string, target_local_id string, relation_type string, assertion_level string, confidence string, rationale string, {_EVIDENCE}"


@dataclass
class Registered:
    nodes: DataFrame
    evidence: DataFrame
    edges: DataFrame
    proposals: DataFrame
    rejected: DataFrame
    links: DataFrame


def _text(x: Column | str) -> Column:
    """Normalised text, null if nothing is left."""
    return F.nullif(tx.norm_text(F.coalesce(x, F.lit(""))), F.lit(""))


def _fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def _local(x: Column | str) -> Column:
    return F.nullif(tx.strip(F.coalesce(x, F.lit(""))), F.lit(""))


def _one_of(x: str, known: tuple[str, ...], default: str) -> Column:
    """Unknown words become the default."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(low.isin(*known), low).otherwise(default)


def gated(rows: DataFrame, sources: DataFrame, scope: DataFrame) -> DataFrame:
    """C05 within chunks: per seq its proof (array in order) and the first fault, if any; rows without evidence are absent.

    sources: source_id, text; scope: chunk_id, source_id, the sources that a chunk may cite.
    """
    items = rows.select("seq", "chunk_id", F.posexplode("evidence").alias("at", "e"))
    items = items.select("seq", "chunk_id", "at", tx.strip(F.coalesce("e.source_object_id", F.lit(""))).alias("source_id"), tx.norm_text(F.coalesce("e.quote", F.lit(""))).alias("quote"))
    inside = scope.select("chunk_id", "source_id").distinct().withColumn("inside", F.lit(True))
    seen = items.join(inside, ["chunk_id", "source_id"], "left").join(sources.select("source_id", "text"), "source_id", "left")
    exact, loose = F.col("text").contains(F.col("quote")), tx.squeezed("text").contains(tx.squeezed("quote"))
    fault = F.when(F.col("text").isNull(), "unknown source").when(F.col("inside").isNull(), "source outside the chunk").when(F.col("quote") == "", "empty quote").when(~exact & ~loose, "quote not in source")
    one = F.struct("at", "source_id", "quote", tx.sha256("quote").alias("quote_sha256"), F.when(exact, "exact").otherwise("whitespace_normalized").alias("match_mode"))
    return seen.groupBy("seq").agg(F.array_sort(F.collect_list(one)).alias("proof"), F.min(F.when(fault.isNotNull(), F.struct(F.col("at"), fault.alias("fault")))).getField("fault").alias("fault"))


def _checked(candidates: DataFrame, sources: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidates with labels, references, value, node_id and reason (null if admitted)."""
    known = candidates.where(F.col("kind").isin(*KINDS))
    rows = known.join(gated(known.where("kind <> 'entity'"), sources, scope), "seq", "left")
    point, entity = F.col("kind") == "data_point", F.col("kind") == "entity"
    v = vl.canonical_value(*(f"value.{c}" for c in ("kind", "raw", "normalized_decimal", "range_low", "range_high", "scale")))
    qualifier = F.coalesce(F.nullif(F.col("qualifier"), F.lit("")), F.lit("actual"))
    subject = F.coalesce(_text("subject_name"), F.when(point & qualifier.isin(*ISSUER_QUALIFIERS), _text("issuer")))
    rows = rows.withColumns({"v": v, "label": _text("text"), "local_id": _local("local_id"), "qualifier": qualifier, "subject": F.when(entity, _text("name")).otherwise(subject)})
    rows = rows.withColumns({"subject_type": F.when(entity, _one_of("entity_type", ENTITY_TYPES, "other")).otherwise("company"), "metric": F.when(F.col("kind").isin("data_point", "claim"), _text("metric_name")), "period": F.when(~entity, _text("period_label")), "corpus": F.array_join(F.transform("proof", lambda e: e["quote"]), " ")})
    bare = F.col("local_id").isNull() | F.col("proof").isNull() | (~point & F.col("label").isNull())
    reason = (
        F.when(entity, F.lit(None)).when(F.col("fault").isNotNull(), F.col("fault")).when(point & F.col("v.reject_reason").isNotNull(), F.col("v.reject_reason")).when(bare, "local id, text or evidence missing")
        .when(point & ~tx.glyphs_present("v.raw", F.coalesce("corpus", F.lit(""))), "number not in evidence").when(point & (F.col("metric").isNull() | F.col("period").isNull()), UNLABELLED)
    )
    ref = lambda label, prefix, *more: F.when(F.col(label).isNotNull(), tx.stable_id(prefix, *more, _fold(F.col(label))))
    rows = rows.withColumns({"reason": reason, "subject_ref": ref("subject", "ENT", "subject_type"), "metric_ref": ref("metric", "MET"), "period_ref": ref("period", "PER")})
    plain = lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"^\+", "")
    number = F.when(F.col("v.kind") == "scalar", plain(F.regexp_extract("v.raw", tx.NUMBER, 0))).otherwise(plain(F.col("value.normalized_decimal")))
    cites = F.array_join(F.concat(F.array(_fold(F.col("label"))), F.transform("proof", lambda e: e["source_id"])), "\x1f")
    node = (
        F.when(entity, F.col("subject_ref"))
        .when(point, tx.stable_id("DATA", "subject_ref", "metric_ref", "period_ref", "v.kind", "v.raw", number, plain(F.col("value.range_low")), plain(F.col("value.range_high")), "qualifier"))
        .when(F.col("kind") == "event", tx.stable_id("EVT", cites)).otherwise(tx.stable_id("CLM", cites))
    )
    return written(rows.withColumn("node_id", node))


def _dimensions(rows: DataFrame) -> DataFrame:
    """Entities, metrics and periods that passing candidates name, and those whose only fault is a missing label; first spelling."""
    named = rows.where(F.col("reason").isNull() | (F.col("reason") == UNLABELLED))
    each = F.array(*[F.struct(F.col(f"{c}_ref").alias("id"), F.lit(t).alias("node_type"), F.col(c).alias("label"), F.when(F.lit(c == "subject"), F.col("subject_type")).alias("entity_type")) for c, t in (("subject", "Entity"), ("metric", "Metric"), ("period", "Period"))])
    flat = named.select("seq", F.explode(each).alias("d")).select("seq", "d.*").where("id is not null")
    return flat.groupBy("id", "node_type").agg(F.min_by("label", "seq").alias("label"), F.min_by("entity_type", "seq").alias("entity_type"))


def _edges(rows: DataFrame) -> DataFrame:
    """Explicit edges, one per (type, source, target), with their id."""
    keyed = rows.groupBy("edge_type", "source_id", "target_id").agg(F.min_by("evidence_quote_sha256", "seq").alias("evidence_quote_sha256"))
    return keyed.select(tx.stable_id("EDGE", "edge_type", "source_id", "target_id").alias("id"), "edge_type", "source_id", "target_id", F.lit("EXPLICIT").alias("assertion_level"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"), "evidence_quote_sha256")


def register(candidates: DataFrame, relations: DataFrame, sources: DataFrame, scope: DataFrame) -> Registered:
    """The graph that candidates (CANDIDATE) and relations (RELATION) make, given sources and what each chunk may cite.

    Candidates of unknown kinds are ignored. A data point that occurs again adds its evidence; a claim or event that
    occurs again adds edges only. Empty tables give empty results.
    """
    rows = _checked(candidates, sources, scope)
    good = rows.where("reason is null and kind <> 'entity'")
    linked = rows.where("reason is null and local_id is not null and node_id is not null")
    place = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), F.col("seq"))
    links = written(linked.groupBy("chunk_id", "local_id").agg(F.max_by(F.struct("node_id", "kind"), place).alias("x")).select("chunk_id", "local_id", "x.*"))

    point, claim = F.col("kind") == "data_point", F.col("kind") == "claim"
    unit = vl.value_unit("v.raw", "corpus", "value.unit")
    label = F.when(point, F.format_string("%s %s = %s", F.col("metric"), F.col("period"), F.col("v.raw"))).otherwise(F.col("label"))
    fields = {
        "node_type": F.when(point, "DataPoint").when(claim, "Claim").otherwise("Event"), "label": label, "subject_ref": F.col("subject_ref"), "metric_ref": F.col("metric_ref"), "period_ref": F.col("period_ref"),
        "qualifier": F.when(point, F.col("qualifier")), "value": F.when(point, F.col("v").dropFields("reject_reason")), "unit": F.when(point, F.coalesce(unit, F.struct("value.unit", "value.currency", "value.scale"))),
        "claim_role": F.when(claim, _one_of("claim_role", CLAIM_ROLES, "interpretation")), "modality": F.when(claim, _one_of("modality", MODALITIES, "opinion")),
        "polarity": F.when(claim, F.coalesce("polarity", F.lit("neutral"))), "importance": F.when(claim, F.coalesce("importance", F.lit("supporting"))), "predicate": F.when(claim, F.coalesce("predicate", F.lit("ASSERTS"))),
        "object_text": F.when(claim, tx.norm_text(F.coalesce("object_text", F.lit("")))), "category": F.when(F.col("kind") == "event", F.coalesce("category", F.lit("other"))), "assertion_level": F.lit("EXPLICIT"),
    }
    firsts = good.groupBy("node_id").agg(F.min_by(F.struct(*[c.alias(n) for n, c in fields.items()], "proof"), "seq").alias("x")).select(F.col("node_id").alias("id"), "x.*")
    nodes = firsts.drop("proof").unionByName(_dimensions(rows), allowMissingColumns=True).withColumn("status", F.lit("active"))

    flat = good.select("seq", "kind", "node_id", F.explode("proof").alias("e")).select("seq", "kind", "node_id", "e.*")
    again = flat.where(point).select("node_id", "source_id", "quote", "quote_sha256", "match_mode")
    once = firsts.where("node_type <> 'DataPoint'").select(F.col("id").alias("node_id"), F.explode("proof").alias("e")).select("node_id", "e.source_id", "e.quote", "e.quote_sha256", "e.match_mode")
    evidence = again.unionByName(once).dropDuplicates(["node_id", "source_id", "quote_sha256"])  # quote and mode follow from the key

    null = F.lit(None).cast("string").alias("evidence_quote_sha256")
    cites = flat.select(F.struct("seq", "at").alias("seq"), F.lit("EVIDENCED_BY").alias("edge_type"), F.col("node_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("quote_sha256").alias("evidence_quote_sha256"))
    at = F.struct("seq", F.lit(0).alias("at")).alias("seq")
    about = (("ABOUT", "subject_ref"), ("MEASURES", "metric_ref"), ("VALID_DURING", "period_ref"))
    parts = [good.where(F.col(c).isNotNull()).select(at, F.lit(t).alias("edge_type"), F.col("node_id").alias("source_id"), F.col(c).alias("target_id"), null) for t, c in about]
    data = good.where(claim).select("seq", "chunk_id", F.col("node_id").alias("source_id"), F.explode("data_point_local_ids").alias("local_id"))
    data = data.join(links.where("kind = 'data_point'").select("chunk_id", "local_id", F.col("node_id").alias("target_id")), ["chunk_id", "local_id"])
    edges = cites
    for p in (*parts, data.select(at, F.lit("HAS_DATA").alias("edge_type"), "source_id", "target_id", null)):
        edges = edges.unionByName(p)

    proposals, refused = _proposals(relations, links, sources, scope)
    rejected = rows.where("reason is not null").select("kind", "chunk_id", "seq", "local_id", "reason").unionByName(refused)
    return Registered(nodes, evidence, _edges(edges), proposals, rejected, links)


def _proposals(relations: DataFrame, links: DataFrame, sources: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations between nodes of a chunk as proposals, and those refused."""
    end = lambda side: links.select("chunk_id", F.col("local_id").alias(f"{side}_local_id"), F.col("node_id").alias(f"{side}_id"))
    rows = relations.join(end("source"), ["chunk_id", "source_local_id"], "left").join(end("target"), ["chunk_id", "target_local_id"], "left").join(gated(relations, sources, scope), "seq", "left")
    kind, level = F.upper(F.coalesce("relation_type", F.lit(""))), F.when(F.upper("assertion_level") == "EXPLICIT", "EXPLICIT").otherwise("INFERRED")
    sure = F.coalesce(F.col("source_id") != F.col("target_id"), F.lit(False)) & kind.isin(*RELATION_TYPES)
    explicit = level == "EXPLICIT"
    reason = F.when(~sure, "unknown relation type, reference or loop").when(explicit & F.col("fault").isNotNull(), F.col("fault")).when(explicit & F.col("proof").isNull(), "explicit relation without evidence").when(vl.confidence("confidence").isNull(), "confidence is not a number from 0 to 1")
    rows = written(rows.withColumns({"relation_type": kind, "assertion_level": level, "reason": reason, "confidence": vl.confidence("confidence"), "rationale": tx.norm_text(F.coalesce("rationale", F.lit("")))}))
    proof = F.when(F.col("fault").isNull(), F.col("proof")).alias("evidence")
    good = rows.where("reason is null").select(tx.stable_id("RELPROP", "chunk_id", "relation_type", "source_id", "target_id").alias("proposal_id"), "source_id", "target_id", "relation_type", "assertion_level", "confidence", "rationale", proof, F.lit("within_chunk").alias("origin"))
    return good, rows.where("reason is not null").select(F.lit("relation").alias("kind"), "chunk_id", "seq", F.lit(None).cast("string").alias("local_id"), "reason")
