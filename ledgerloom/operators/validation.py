"""The validator: every rule is a DataFrame (code, message, object_id); a graph passes if their union has no error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glyphs_present, norm_text, sha256, squeezed, strip
from ..functions.values import value_errors
from .graph import ACCEPT_AT, ARGUMENT_TYPES, EDGE_TYPES, NODE_TYPES, cyclic_nodes, dangling

STATUSES = ("EXTRACTED", "NO_CLAIM", "OPAQUE", "NEEDS_REVIEW")
#: Roles of core claims that should be argued for.
ARGUED = ("recommendation", "valuation", "forecast", "interpretation")
SEMANTIC = ("Claim", "DataPoint", "Event")
ROOT_FIELDS = ("schema_version", "graph_id", "state_hash", "document", "source_objects", "nodes", "edges", "extraction_run", "coverage_manifest", "rejected_candidates")


def issue(rows: DataFrame, code: str | Column, message: str, object_id: str | Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    object_id = F.col(object_id) if isinstance(object_id, str) else object_id
    return rows.select(code.alias("code"), F.lit(message).alias("message"), object_id.cast("string").alias("object_id"))


def duplicates(*frames: DataFrame) -> DataFrame:
    """Ids that occur more than once over all frames (column id), with their count; rows without an id don't count."""
    ids = reduce(DataFrame.union, [f.select("id") for f in frames]).where("id <> ''")
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def id_rule(rows: DataFrame, code: str) -> DataFrame:
    """Rows without an id, and ids of several rows of one kind."""
    return issue(rows.where("coalesce(id, '') = ''").select("id").union(duplicates(rows).select("id")), code, "not every row has an id of its own", "id")


def source_rules(documents: DataFrame, sources: DataFrame) -> list[DataFrame]:
    return [
        issue(sources.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti"), "SOURCE_DOCUMENT", "unknown document", "id"),
        issue(sources.where(~sha256(F.coalesce("raw_text", F.lit(""))).eqNullSafe(F.col("sha256"))), "SOURCE_HASH", "raw text and digest differ", "id"),
        issue(sources.where(~F.coalesce(F.col("processing_status").isin(*STATUSES, "ERROR"), F.lit(False))), "SOURCE_STATUS", "unknown status", "id"),
        issue(sources.where("processing_status = 'ERROR'"), "SOURCE_ERROR", "processing failed", "id"),
    ]


def edge_rules(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    lost = dangling(nodes, edges, sources)
    twice = edges.groupBy("edge_type", "source_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n > 1")
    argued = edges.where(F.col("edge_type").isin(*ARGUMENT_TYPES) & (F.col("status") == "active"))
    sure = (F.col("verdict") == "accept") & (F.col("verdict_confidence") >= ACCEPT_AT)
    return [
        issue(edges.where(~F.col("edge_type").isin(*EDGE_TYPES)), "EDGE_TYPE", "unknown edge type", "id"),
        issue(lost, F.col("code"), "missing end", "id"),
        issue(twice, "DUPLICATE_EDGE", "edge repeated", "id"),
        issue(argued.where((F.col("assertion_level") == "INFERRED") & ~F.coalesce(sure, F.lit(False))), "UNVERIFIED_INFERRED_EDGE", "inference not accepted", "id"),
        issue(argued.where((F.col("assertion_level") == "EXPLICIT") & ~F.coalesce(F.col("has_evidence"), F.lit(False))), "EXPLICIT_RELATION_EVIDENCE", "explicit relation without evidence", "id"),
    ]


def parity(own: DataFrame, linked: DataFrame) -> DataFrame:
    """node_id of the nodes whose evidence (node_id, source_id) and evidence edges name different sources."""
    both = own.select("node_id", "source_id", F.lit(1).alias("o"), F.lit(0).alias("l")).union(linked.select("node_id", "source_id", F.lit(0), F.lit(1)))
    return both.groupBy("node_id", "source_id").agg(F.max("o").alias("o"), F.max("l").alias("l")).where("o <> l").select("node_id").distinct()


def evidence_rules(nodes: DataFrame, edges: DataFrame, sources: DataFrame, evidence: DataFrame) -> list[DataFrame]:
    """evidence: node_id, source_id, quote, quote_sha256, match_mode (null counts as exact)."""
    texts = sources.select(F.col("id").alias("source_id"), "normalized_text")
    evidence = evidence.withColumn("quote", norm_text(F.coalesce("quote", F.lit(""))))
    found = evidence.join(texts, "source_id", "left")
    mode, text = F.coalesce("match_mode", F.lit("exact")), F.coalesce("normalized_text", F.lit(""))
    inside = F.when(mode == "exact", text.contains(F.col("quote"))).when(mode == "whitespace_normalized", squeezed(text).contains(squeezed("quote"))).otherwise(False)
    own = evidence.select("node_id", "source_id")
    linked = edges.where("edge_type = 'EVIDENCED_BY'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("source_id"))
    apart = parity(own, linked.join(nodes.where(F.col("node_type").isin(*SEMANTIC)).select(F.col("id").alias("node_id")), "node_id", "left_semi"))
    bare = nodes.where(F.col("node_type").isin(*SEMANTIC) & (F.col("assertion_level") == "EXPLICIT")).join(evidence.select(F.col("node_id").alias("id")), "id", "left_anti")
    return [
        issue(found.where("normalized_text is null"), "NODE_EVIDENCE_REF", "unknown source", "node_id"),
        issue(evidence.where(~sha256("quote").eqNullSafe(F.col("quote_sha256"))), "EVIDENCE_QUOTE_HASH", "quote and digest differ", "node_id"),
        issue(found.where(F.col("normalized_text").isNotNull() & ~inside), "EVIDENCE_QUOTE", "quote not in source", "node_id"),
        issue(apart, "EVIDENCE_EDGE_PARITY", "evidence and edges differ", "node_id"),
        issue(bare, "EXPLICIT_NODE_EVIDENCE", "explicit node without evidence", "id"),
    ]


def node_rules(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> list[DataFrame]:
    ids = nodes.select(F.col("id").alias("ref"), F.col("node_type").alias("ref_type"))
    data, steps = nodes.where("node_type = 'DataPoint'"), nodes.where("node_type = 'ReasoningStep'")
    refs = data.select("id", F.explode(F.array(*[F.struct(F.col(c).alias("ref"), F.lit(t).alias("want")) for c, t in (("subject_ref", "Entity"), ("metric_ref", "Metric"), ("period_ref", "Period"))])).alias("r")).select("id", "r.*")
    context = refs.join(ids, "ref", "left").where(~F.col("ref_type").eqNullSafe(F.col("want"))).select("id").distinct()
    corpus = evidence.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("quote")), " ").alias("corpus"))
    raw = data.join(corpus, "id", "left").where(~glyphs_present("value.raw", F.coalesce("corpus", F.lit(""))))
    errors = data.select("id", F.explode(value_errors("value.kind", "value.normalized_decimal", "value.range_low", "value.range_high", "value.scale")).alias("code"))
    premises = steps.select("id", F.explode("premise_node_ids").alias("p"))
    ends = steps.select("id", F.explode("conclusion_claim_ids").alias("c"))
    has = lambda t, a, b: edges.where(F.col("edge_type") == t).select(F.col("source_id").alias(a), F.col("target_id").alias(b))
    lacking = lambda rows, linked, c, known: rows.join(known.select(F.col("id").alias(c)).join(linked, c).select("id", c), ["id", c], "left_anti")
    empty = (F.coalesce(F.size("premise_node_ids"), F.lit(0)) < 1) | (F.coalesce(F.size("conclusion_claim_ids"), F.lit(0)) < 1)
    return [
        issue(nodes.where(~F.col("node_type").isin(*NODE_TYPES)), "NODE_TYPE", "unknown node type", "id"),
        issue(nodes.where(strip(F.coalesce("label", F.lit(""))) == ""), "NODE_LABEL", "empty label", "id"),
        issue(context, "DATA_CONTEXT", "subject, metric or period missing", "id"),
        issue(errors, F.col("code"), "value not valid", "id"),
        issue(raw, "DATA_RAW_EVIDENCE", "number not in evidence", "id"),
        issue(steps.where(empty), "REASONING_SHAPE", "premise or conclusion missing", "id"),
        issue(lacking(premises, has("PREMISE_OF", "p", "id"), "p", nodes), "REASONING_PREMISE", "premise unknown or without edge", "id"),
        issue(lacking(ends, has("CONCLUDES", "id", "c"), "c", nodes.where("node_type = 'Claim'")), "REASONING_CONCLUSION", "conclusion no claim or without edge", "id"),
    ]


def dag_rule(edges: DataFrame) -> DataFrame:
    argued = edges.where(F.col("edge_type").isin(*ARGUMENT_TYPES) & (F.col("status") == "active"))
    return issue(cyclic_nodes(argued), "ARGUMENT_DAG", "argument cycle", "id")


def warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    backed = edges.where(F.col("edge_type").isin(*ARGUMENT_TYPES) & (F.col("status") == "active")).select(F.col("target_id").alias("id"))
    core = nodes.where((F.col("node_type") == "Claim") & (F.col("importance") == "core") & F.col("claim_role").isin(*ARGUED))
    return issue(core.join(backed, "id", "left_anti"), "CORE_CLAIM_WITHOUT_ARGUMENT", "core claim without argument", "id")


def errors(documents: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """All errors of one graph; PASS iff there is none."""
    twice = issue(duplicates(documents, sources, nodes, edges), "UNIQUE_IDS", "id repeated", "id")
    named = [id_rule(sources, "SOURCE_IDS"), id_rule(nodes, "NODE_IDS"), id_rule(edges, "EDGE_IDS")]
    rules = [twice, *named, *source_rules(documents, sources), *edge_rules(nodes, edges, sources), *evidence_rules(nodes, edges, sources, evidence), *node_rules(nodes, edges, evidence), dag_rule(edges)]
    return reduce(DataFrame.unionByName, rules)


def header_rules(headers: DataFrame, version: str, hashes: DataFrame) -> list[DataFrame]:
    """headers: graph_id, json (root document), schema_version, state_hash; hashes: graph_id, computed (state_hash of its tables)."""
    both = headers.join(hashes, "graph_id", "left")
    return [
        issue(headers.where(~F.col("schema_version").eqNullSafe(F.lit(version))), "SCHEMA_VERSION", "other schema version", "graph_id"),
        issue(headers.where(F.coalesce(F.size(missing_fields(F.col("json"))) != 0, F.lit(True))), "ROOT_FIELDS", "root fields missing", "graph_id"),
        issue(both.where(~F.col("state_hash").eqNullSafe(F.col("computed"))), "STATE_HASH", "state hash and content differ", "graph_id"),
    ]


def file_rules(documents: DataFrame, files: DataFrame) -> list[DataFrame]:
    """documents: id, local_path, sha256; files: local_path, content (binary) of what has landed."""
    landed = documents.join(files.select("local_path", F.sha2("content", 256).alias("actual")), "local_path", "left")
    return [
        issue(landed.where("actual is null"), "SOURCE_FILE_EXISTS", "file missing", "id"),
        issue(landed.where(F.col("actual").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("actual"))), "SOURCE_FILE_HASH", "file and digest differ", "id"),
    ]


def coverage_rules(sources: DataFrame, nodes: DataFrame, evidence: DataFrame, manifest: DataFrame) -> list[DataFrame]:
    """manifest, one row: graph_id, status_counts (map of status to count), terminal, evidence_coverage."""
    counts = sources.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))
    told = manifest.select(F.explode("status_counts").alias("processing_status", "told"))
    apart = counts.join(told, "processing_status", "full_outer").where(~F.col("n").eqNullSafe(F.col("told")))
    total = sources.agg(F.count(F.lit(1)).alias("total"))
    semantic = nodes.where(F.col("node_type").isin(*SEMANTIC)).select("id")
    backed = semantic.join(evidence.select(F.col("node_id").alias("id")), "id", "left_semi").agg(F.count(F.lit(1)).alias("backed"))
    share = semantic.agg(F.count(F.lit(1)).alias("semantic")).join(F.broadcast(backed))  # one row each
    return [
        issue(apart, "COVERAGE_STATUS_COUNTS", "status counts differ", "processing_status"),
        issue(manifest.join(F.broadcast(total)).where("not terminal <=> total"), "COVERAGE_TERMINAL", "not every source has a status", "graph_id"),
        issue(manifest.join(F.broadcast(share)).where(~F.col("evidence_coverage").eqNullSafe(ratio(F.col("backed"), F.col("semantic")))), "COVERAGE_EVIDENCE", "evidence coverage differs", "graph_id"),
    ]


def report(errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row with status (PASS iff there is no error) and the numbers of errors and warnings."""
    n = errors.agg(F.count(F.lit(1)).alias("errors")).join(F.broadcast(warnings.agg(F.count(F.lit(1)).alias("warnings"))))
    return n.select(F.when(F.col("errors") == 0, "PASS").otherwise("FAIL").alias("status"), "errors", "warnings")


def missing_fields(json: Column) -> Column:
    """Root fields that a graph document lacks."""
    return F.array_except(F.array(*map(F.lit, ROOT_FIELDS)), F.json_object_keys(json))


#: The root fields that make a graph's state; the others are about its run: fixed values.
STATE_FIELDS = ("schema_version", "graph_id", "document", "source_objects", "nodes", "edges")


def state_payload(json: Column) -> Column:
    """The state fields of a graph document as JSON, absent ones as null, lists empty; the rest is left out."""
    document = F.try_parse_json(json)
    lists = STATE_FIELDS[3:]
    field = lambda f: F.coalesce(F.to_json(F.try_variant_get(document, f"$.{f}", "variant")), F.lit("[]" if f in lists else "null"))
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), field(f)) for f in sorted(STATE_FIELDS)]), F.lit("}"))


def state_hash(table: DataFrame) -> DataFrame:
    """One digest of a table's rows, whatever their order and partitions.

    The digests of the rows are added up word by word (32 bits each), so that a task holds no more than eight sums; the
    digest is that of the row count and the sums.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns))).cast("binary"), 256)
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = table.select(row.alias("h")).agg(F.count(F.lit(1)).cast("string").alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select(sha256(F.concat_ws(":", "n", *[f"w{i}" for i in range(8)])).alias("state_hash"))


def dispositions(sources: DataFrame, references: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sources with candidate_count and processing_status. references: source_id; reviews: source_id, classification."""
    counted = references.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    joined = sources.join(counted, sources.id == counted.source_id, "left").drop("source_id").join(reviews, F.col("id") == F.col("source_id"), "left").drop("source_id")
    c = F.col("classification")
    status = F.when(F.col("n") > 0, "EXTRACTED").when(c.isin("administrative", "legal"), "NO_CLAIM").when((c == "opaque") | (F.col("object_type") == "figure_caption"), "OPAQUE").otherwise("NEEDS_REVIEW")
    return joined.select("id", F.coalesce("n", F.lit(0)).alias("candidate_count"), status.alias("processing_status"))


def ratio(part: Column, whole: Column) -> Column:
    """Rounded half even to 6 places; 1 for an empty whole."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.bround(part / whole, 6))
