"""The validator with its rules fused: each table of the graphs is read once (sources twice) and gives all it has to say.

A row is turned into items, by kind: codes that it earns by itself; names under which it can be found (its id, the key of
an edge, a node and source that evidence joins); references to such names with what must be found there; quotes to look up
in a source; counts for the coverage manifest; argument edges. The items are written once, a row for each row of the tables
with a list for each kind, so that a reader of one kind reads its columns only and nothing is sorted. One aggregate over the
names meets all references in one join, which tells both what is named twice and what references don't find; the rest is
one join for all quotes, and one aggregate for all counts.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import glyphs_present, norm_text, sha256, squeezed, strip
from ..functions.values import value_errors
from ..plans.rounds import partitions, written
from .graph import ACCEPT_AT, ARGUMENT_TYPES, EDGE_TYPES, NODE_TYPES, cyclic_nodes
from .validation import ARGUED, SEMANTIC, STATUSES, missing_fields, ratio

#: Kinds of names, each counted apart.
NAMES = ("document", "source", "node", "edge", "edge_key", "proof", "argued")
WARNINGS = ("CORE_CLAIM_WITHOUT_ARGUMENT",)
PARITY = "EVIDENCE_EDGE_PARITY"
#: Fields of the items of each kind.
KINDS = {
    "code": {"code": "string", "object_id": "string", "detail": "string"},
    "name": {"name": "string", "key": "string", "node_type": "int"},
    "reference": {"code": "string", "object_id": "string", "detail": "string", "key": "string", "name": "string", "node_type": "int", "guard": "string"},
    "quote": {"object_id": "string", "key": "string", "quote": "string", "mode": "string", "fits": "boolean"},
    "count": {"key": "string", "n": "long", "m": "long", "told": "double"},
    "argument": {"key": "string", "detail": "string"},
}
_SEP = "\x1f"


def _item(kind: str, **columns: Column | str | int) -> Column:
    """A struct of the kind's fields, null where nothing is given."""
    return F.struct(*[(columns[c] if isinstance(columns.get(c), Column) else F.lit(columns.get(c))).cast(t).alias(c) for c, t in KINDS[kind].items()])


def _code(when: Column, code: str, object_id: Column, detail: Column | str | None = None) -> Column:
    return F.when(when, _item("code", code=code, object_id=object_id, **({} if detail is None else {"detail": detail})))


def _type_number(node_type: Column) -> Column:
    """The place of a node type among NODE_TYPES from 1 on; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, NODE_TYPES)), node_type).cast("int"), F.lit(0))


_TYPE = {t: i for i, t in enumerate(NODE_TYPES, 1)}


def _key(*parts: Column | str) -> Column:
    """A name made of parts, null if one of them is."""
    return F.concat(*[x for p in parts for x in (F.lit(_SEP), p if isinstance(p, Column) else F.lit(p))])


def _items(rows: DataFrame, single: dict[str, list[Column]], lists: dict[str, list[Column]] | None = None) -> DataFrame:
    """graph_id and a list of items for each kind, made of single ones and of lists, both of which may be null."""

    def every(kind: str) -> Column:
        of = f"array<struct<{','.join(f'{c}:{t}' for c, t in KINDS[kind].items())}>>"
        parts = [F.array_compact(F.array(*single[kind]))] if single.get(kind) else []
        parts += [F.coalesce(x, F.array().cast(of)) for x in (lists or {}).get(kind, [])]
        return (F.concat(*parts) if parts else F.lit(None)).cast(of).alias(kind)

    return rows.select("graph_id", *map(every, KINDS))


def header_items(headers: DataFrame, files: DataFrame, version: str, schema: str | None = None) -> DataFrame:
    """headers: graph_id, json, schema_version, state_hash, computed (of the content), document_id, local_path, sha256, status_counts, terminal, evidence_coverage.

    files: local_path, content; schema: the text of a schema document, whose constant must be `version`.
    """
    rows = headers.join(files.select("local_path", F.sha2("content", 256).alias("actual")), "local_path", "left")
    g, other = F.col("graph_id"), F.lit(False)
    if schema is not None:
        other = F.lit(json.loads(schema).get("properties", {}).get("schema_version", {}).get("const") != version)
    codes = [
        _code(~F.col("schema_version").eqNullSafe(F.lit(version)), "SCHEMA_VERSION", g),
        _code(F.coalesce(F.size(missing_fields(F.col("json"))) != 0, F.lit(True)), "ROOT_FIELDS", g),
        _code(other, "SCHEMA_DOCUMENT_VERSION", g),
        _code(~F.col("state_hash").eqNullSafe(F.col("computed")), "STATE_HASH", g),
        _code(F.col("actual").isNull(), "SOURCE_FILE_EXISTS", F.col("document_id")),
        _code(F.col("actual").isNotNull() & ~F.col("actual").eqNullSafe(F.col("sha256")), "SOURCE_FILE_HASH", F.col("document_id")),
        _code(F.col("status_counts").isNull(), "COVERAGE_STATUS_COUNTS", g),
    ]
    counts = [_item("count", key="terminal", n=0, told=F.col("terminal")), _item("count", key="evidence", n=0, m=0, told=F.col("evidence_coverage"))]
    told = F.transform(F.map_entries("status_counts"), lambda e: _item("count", key=F.concat(F.lit("status "), e["key"]), n=0, told=e["value"]))
    return _items(rows, {"code": codes, "name": [_item("name", name="document", key=F.col("document_id"))], "count": counts}, {"count": [told]})


def source_items(sources: DataFrame) -> DataFrame:
    """sources: graph_id, id, document_id, raw_text, normalized_text, sha256, processing_status."""
    i, status = F.col("id"), F.col("processing_status")
    codes = [
        _code(~sha256(F.coalesce("raw_text", F.lit(""))).eqNullSafe(F.col("sha256")), "SOURCE_HASH", i),
        _code(~F.coalesce(status.isin(*STATUSES, "ERROR"), F.lit(False)), "SOURCE_STATUS", i, status),
        _code(F.coalesce(status == "ERROR", F.lit(False)), "SOURCE_ERROR", i),
    ]
    counts = [F.when(i.isNotNull(), _item("count", key=F.concat(F.lit("status "), F.coalesce(status, F.lit(""))), n=1)), _item("count", key="terminal", n=1)]
    asked = _item("reference", code="SOURCE_DOCUMENT", object_id=i, key=F.col("document_id"), name="document")
    return _items(sources, {"code": codes, "name": [_item("name", name="source", key=i)], "reference": [asked], "count": counts})


def node_items(nodes: DataFrame) -> DataFrame:
    """nodes: graph_id, id, node_type, label, assertion_level, importance, claim_role, subject_ref, metric_ref, period_ref, value,
    premise_node_ids, conclusion_claim_ids, evidence (array of source_object_id, quote, quote_sha256, match_mode).

    A node of an unknown type earns that code alone, and can be found by its id.
    """
    i, kind = F.col("id"), F.col("node_type")
    known = F.coalesce(kind.isin(*NODE_TYPES), F.lit(False))
    is_ = lambda *t: F.coalesce(kind.isin(*t), F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    bare = size("evidence") < 1
    quotes = F.array_join(F.transform("evidence", lambda e: F.coalesce(e["quote"], F.lit(""))), " ")
    v = lambda f: F.col(f"value.{f}")
    codes = [
        _code(~known, "NODE_TYPE", i, kind),
        _code(known & (strip(F.coalesce("label", F.lit(""))) == ""), "NODE_LABEL", i),
        _code(is_(*SEMANTIC) & bare & (F.col("assertion_level") == "EXPLICIT"), "EXPLICIT_NODE_EVIDENCE", i),
        _code(is_("DataPoint") & ~F.coalesce(glyphs_present(F.coalesce(v("raw"), F.lit("")), F.coalesce(quotes, F.lit(""))), F.lit(True)), "DATA_RAW_EVIDENCE", i),
        _code(is_("ReasoningStep") & ((size("premise_node_ids") < 1) | (size("conclusion_claim_ids") < 1)), "REASONING_SHAPE", i),
    ]
    backed = F.when(is_(*SEMANTIC), _item("count", key="evidence", n=1, m=F.when(bare, 0).otherwise(1)))
    core = F.when(is_("Claim") & (F.col("importance") == "core") & F.col("claim_role").isin(*ARGUED), _item("reference", code=WARNINGS[0], object_id=i, key=_key("a", i), name="argued"))
    context = F.array(*[_item("reference", code="DATA_CONTEXT", object_id=i, detail=c, key=F.col(c), name="node", node_type=_TYPE[t]) for c, t in (("subject_ref", "Entity"), ("metric_ref", "Metric"), ("period_ref", "Period"))])
    wrong = F.transform(value_errors("value.kind", "value.normalized_decimal", "value.range_low", "value.range_high", "value.scale"), lambda c: _item("code", code=c, object_id=i))
    told = lambda f: F.when(is_(*SEMANTIC), F.transform("evidence", f))

    def quoted(e: Column) -> Column:
        quote = norm_text(F.coalesce(e["quote"], F.lit("")))
        return _item("quote", object_id=i, key=e["source_object_id"], quote=quote, mode=F.coalesce(e["match_mode"], F.lit("exact")), fits=sha256(quote).eqNullSafe(e["quote_sha256"]))

    proof = lambda e: _item("name", name="proof", key=_key("p", i, e["source_object_id"]))
    linked = lambda e: _item("reference", code=PARITY, object_id=i, key=_key("k", "EVIDENCED_BY", i, e["source_object_id"]), name="edge_key")

    def step(ids: str, code: str, of: int | None, edge) -> Column:
        both = lambda x: F.array(_item("reference", code=code, object_id=i, detail=x, key=x, name="node", node_type=of), _item("reference", code=code, object_id=i, detail=x, key=edge(x), name="edge_key"))
        return F.when(is_("ReasoningStep"), F.flatten(F.transform(ids, both)))

    steps = [step("premise_node_ids", "REASONING_PREMISE", None, lambda x: _key("k", "PREMISE_OF", x, i)), step("conclusion_claim_ids", "REASONING_CONCLUSION", _TYPE["Claim"], lambda x: _key("k", "CONCLUDES", i, x))]
    return _items(
        nodes,
        {"code": codes, "name": [_item("name", name="node", key=i, node_type=_type_number(kind))], "reference": [core], "count": [backed]},
        {"code": [F.when(is_("DataPoint"), wrong)], "name": [told(proof)], "reference": [F.when(is_("DataPoint"), context), told(linked), *steps], "quote": [told(quoted)]},
    )


def edge_items(edges: DataFrame) -> DataFrame:
    """edges: graph_id, id, edge_type, source_id, target_id, assertion_level, status, verdict, verdict_confidence, has_evidence."""
    i, kind, source, target, level = (F.col(c) for c in ("id", "edge_type", "source_id", "target_id", "assertion_level"))
    cites = F.coalesce(kind == "EVIDENCED_BY", F.lit(False))
    argued = F.coalesce(kind.isin(*ARGUMENT_TYPES) & (F.col("status") == "active"), F.lit(False))
    sure = F.coalesce((F.col("verdict") == "accept") & (F.col("verdict_confidence") >= ACCEPT_AT), F.lit(False))
    return _items(
        edges,
        {
            "code": [
                _code(~F.coalesce(kind.isin(*EDGE_TYPES), F.lit(False)), "EDGE_TYPE", i, kind),
                _code(argued & (level == "INFERRED") & ~sure, "UNVERIFIED_INFERRED_EDGE", i),
                _code(argued & (level == "EXPLICIT") & ~F.coalesce(F.col("has_evidence"), F.lit(False)), "EXPLICIT_RELATION_EVIDENCE", i),
            ],
            "name": [
                _item("name", name="edge", key=i),
                _item("name", name="edge_key", key=_key("k", kind, source, target)),
                F.when(argued, _item("name", name="argued", key=_key("a", target))),
            ],
            "reference": [
                _item("reference", code="EDGE_SOURCE", object_id=i, key=source, name="node"),
                F.when(cites, _item("reference", code="EVIDENCE_TARGET", object_id=i, key=target, name="source")).otherwise(_item("reference", code="EDGE_TARGET", object_id=i, key=target, name="node")),
                F.when(cites, _item("reference", code=PARITY, object_id=source, key=_key("p", source, target), name="proof", guard=source)),
            ],
            "argument": [F.when(argued, _item("argument", key=source, detail=target))],
        },
    )


def _found(items: DataFrame, sources: DataFrame) -> DataFrame:
    """graph_id, code, object_id, detail of all that the items show to be wrong."""
    of = lambda kind: items.select("graph_id", F.explode(kind).alias("x")).select("graph_id", "x.*")
    out = lambda rows, code=F.col("code"), object_id=F.col("object_id"), detail=F.lit(None).cast("string"): rows.select("graph_id", code.alias("code"), object_id.alias("object_id"), detail.alias("detail"))
    count = lambda n: F.count_if(F.col("name") == n).alias(n)
    held = of("name").repartition(partitions(items, 2), "graph_id", "key").groupBy("graph_id", "key").agg(*map(count, NAMES), F.max("node_type").alias("found_type"))
    h = {n: F.coalesce(F.col(f"h.{n}"), F.lit(0)) for n in NAMES}
    ids = reduce(Column.__add__, [h[n] for n in NAMES[:4]])
    unnamed = F.coalesce("h.key", F.lit("")) == ""
    twice = {"UNIQUE_IDS": (ids > 1) & F.col("h.key").isNotNull(), "DUPLICATE_EDGE": h["edge_key"] > 1} | {f"{n.upper()}_IDS": (h[n] > 1) | ((h[n] > 0) & unnamed) for n in ("source", "node", "edge")}
    there = reduce(lambda a, n: a.when(F.col("r.name") == n, h[n] > 0), NAMES[1:], F.when(F.col("r.name") == NAMES[0], h[NAMES[0]] > 0))
    fits = F.col("r.node_type").isNull() | F.col("r.node_type").eqNullSafe(F.col("h.found_type"))
    lost = F.col("r.code").isNotNull() & ~F.coalesce(there & fits, F.lit(False))

    joined = of("reference").alias("r").join(held.hint("shuffle_hash").alias("h"), (F.col("r.graph_id") == F.col("h.graph_id")) & (F.col("r.key") == F.col("h.key")), "full")
    fault = lambda when, code, graph_id, object_id, detail, guard, named: F.when(when, F.struct(F.col(graph_id).alias("graph_id"), code.alias("code"), object_id.alias("object_id"), detail.alias("detail"), guard.alias("guard"), named.alias("named")))
    null, name = F.lit(None).cast("string"), F.col("h.key")
    own = [fault(when, F.lit(code), "h.graph_id", F.translate(name, _SEP, " "), null, null, name) for code, when in twice.items()]
    asked = fault(lost, F.col("r.code"), "r.graph_id", F.col("r.object_id"), F.col("r.detail"), F.col("r.guard"), null)
    faults = joined.where(reduce(Column.__or__, twice.values(), lost)).select(F.inline(F.array_compact(F.array(asked, *own))))
    semantic = of("name").where("node_type is not null").groupBy("graph_id", F.col("key").alias("guard")).agg(F.max("node_type").alias("found_type")).where(F.col("found_type").isin(*[_TYPE[t] for t in SEMANTIC]))
    named = out(faults.join(semantic, ["graph_id", "guard"], "left").where("guard is null or found_type is not null").select("graph_id", "code", "object_id", "detail", "named").distinct(), detail=F.col("detail"))

    texts = sources.where("id is not null").select("graph_id", F.col("id").alias("key"), F.coalesce("normalized_text", F.lit("")).alias("text"))
    said = of("quote").join(texts, ["graph_id", "key"], "left")
    quote, text = F.col("quote"), F.col("text")
    inside = F.when(F.col("mode") == "exact", text.contains(quote)).when(F.col("mode") == "whitespace_normalized", squeezed(text).contains(squeezed(quote))).otherwise(False)
    wrong = F.when(text.isNull(), F.array(F.lit("NODE_EVIDENCE_REF"))).otherwise(F.array_compact(F.array(F.when(~F.col("fits"), F.lit("EVIDENCE_QUOTE_HASH")), F.when(~inside, F.lit("EVIDENCE_QUOTE")))))
    quotes = said.select("graph_id", "object_id", F.col("key").alias("detail"), F.explode(wrong).alias("code"))

    sums = of("count").groupBy("graph_id", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("told").alias("told"))
    expected = F.when(F.col("key") == "evidence", ratio(F.col("m"), F.col("n"))).otherwise(F.col("n").cast("double"))
    zero = F.col("key").startswith("status ") & (F.col("n") == 0)  # the manifest counts a status that no source has
    code = F.when(F.col("key") == "evidence", "COVERAGE_EVIDENCE").when(F.col("key") == "terminal", "COVERAGE_TERMINAL").otherwise("COVERAGE_STATUS_COUNTS")
    counts = out(sums.where(zero | ~expected.eqNullSafe(F.col("told"))), code, F.col("graph_id")).distinct()

    ends = of("argument").where("key is not null and detail is not null").select(F.struct("graph_id", "key").alias("source_id"), F.struct("graph_id", F.col("detail").alias("key")).alias("target_id"))
    cycles = cyclic_nodes(ends).select("id.graph_id", F.lit("ARGUMENT_DAG").alias("code"), F.col("id.key").alias("object_id"), F.lit(None).cast("string").alias("detail"))
    own_codes = of("code").where("code <> 'COVERAGE_STATUS_COUNTS'").select("graph_id", "code", "object_id", "detail")
    no_counts = out(of("code").where("code = 'COVERAGE_STATUS_COUNTS'").join(counts, ["graph_id", "code"], "left_anti"))
    return reduce(DataFrame.union, [own_codes, no_counts, named, out(quotes, detail=F.col("detail")), counts, cycles])


def audit(headers: DataFrame, files: DataFrame, sources: DataFrame, nodes: DataFrame, edges: DataFrame, version: str, schema: str | None = None) -> tuple[DataFrame, Observation]:
    """graph_id, code, object_id, detail of every error and warning of any number of graphs, and what an action over them
    has seen (errors, warnings): nothing is wrong iff errors is 0.

    Ids are looked up within a graph. What is named many times is a few counters. Names are held in partitions of about a
    million, whose number follows the rows, and references pass by them one by one, so a node that very many rows refer to
    takes a task's time but none of its memory; a source that is quoted very often is a skewed key of a join, which adaptive
    execution splits. Nulls count as absent and earn the code of what they should
    name; columns beyond those named at the item functions are left out. An empty graph earns what its header earns.
    """
    made = [header_items(headers, files, version, schema), source_items(sources), node_items(nodes), edge_items(edges)]
    items = written(reduce(DataFrame.union, made), "items")
    seen = Observation("audit")
    warning = F.col("code").isin(*WARNINGS)
    return _found(items, sources).observe(seen, F.count_if(~warning).alias("errors"), F.count_if(warning).alias("warnings")), seen


def statuses(headers: DataFrame, found: DataFrame) -> DataFrame:
    """graph_id, status (PASS iff there is no error), errors and warnings of every graph."""
    warning = F.col("code").isin(*WARNINGS)
    n = found.groupBy("graph_id").agg(F.count_if(~warning).alias("errors"), F.count_if(warning).alias("warnings"))
    errors = F.coalesce("errors", F.lit(0))
    return headers.select("graph_id").join(n, "graph_id", "left").select("graph_id", F.when(errors == 0, "PASS").otherwise("FAIL").alias("status"), errors.alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
