"""Registration of chunk candidates, the validator's header, file and coverage rules, agenda checks and report."""

import hashlib
from functools import reduce

import pytest
from pyspark.sql import DataFrame

from ledgerloom.operators import agenda, candidates, validation, views
from ledgerloom.sources import landed

TEXT = "Revenue rose to 1,200 in 2024, so we say buy."


def rows_of(spark, schema, *rows):
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(({"seq": i} | r).get(n) for n in names) for i, r in enumerate(rows)], schema)


def point(raw="1,200", quote="rose to 1,200", **more):
    return {"chunk_id": "c1", "kind": "data_point", "local_id": "d1", "metric_name": "Revenue", "period_label": "2024A", "issuer": "ACME", "value": (None, raw, raw, None, None, None, None, None), "evidence": [("s1", quote)]} | more


def claim(**more):
    return {"chunk_id": "c1", "kind": "claim", "local_id": "k1", "text": "We say  BUY", "claim_role": "odd", "modality": "RISK", "subject_name": "acme", "data_point_local_ids": ["d1", "none"], "evidence": [("s1", "we say buy")]} | more


@pytest.fixture(scope="module")
def made(spark):
    rows = rows_of(
        spark, candidates.CANDIDATE, {"chunk_id": "c1", "kind": "entity", "local_id": "e1", "name": "Acme", "entity_type": "company"}, point(), point(quote="Revenue  rose to 1,200", local_id="d2"), claim(),
        claim(text="we say buy", local_id="k2", evidence=[("s1", "so we say buy")]), point(raw="7"), point(evidence=[("s2", "other")]), point(evidence=[("s9", "x")]), point(period_label=" ", metric_name="Margin"), point(local_id=" "), point(raw="none"),
        claim(evidence=[]), claim(evidence=None), claim(evidence=[("s1", "we say buy"), ("s1", "we say sell")]), {"chunk_id": "c1", "kind": "event", "local_id": "v1", "text": "rise", "metric_name": "ignored", "period_label": "2024a", "evidence": [("s1", "Revenue")]},
        {"chunk_id": "c1", "kind": "weird", "local_id": "w"},
    )
    rel = lambda t, a, b, level="INFERRED", conf="0.8", ev=None: {"chunk_id": "c1", "relation_type": t, "source_local_id": a, "target_local_id": b, "assertion_level": level, "confidence": conf, "evidence": ev}
    relations = rows_of(spark, candidates.RELATION, rel("supports", "d1", "k1"), rel("SUPPORTS", "d1", "d2"), rel("LIKES", "d1", "k1"), rel("CAUSES", "v1", "k1", "explicit"), rel("CAUSES", "v1", "k1", "explicit", ev=[("s1", "so we")]), rel("AFFECTS", "v1", "k1", conf='"0.8"'), rel("AFFECTS", "v1", "zz"))
    sources = spark.createDataFrame([("s1", TEXT), ("s2", "other text")], "source_id string, text string")
    return candidates.register(rows, relations, sources, spark.createDataFrame([("c1", "s1"), ("c1", "s1")], "chunk_id string, source_id string"))


def test_nodes_and_evidence(made):
    nodes = made.nodes.collect()
    assert sorted((n.node_type, n.label) for n in nodes) == [("Claim", "We say BUY"), ("DataPoint", "Revenue 2024A = 1,200"), ("Entity", "Acme"), ("Event", "rise"), ("Metric", "Margin"), ("Metric", "Revenue"), ("Period", "2024A")]
    by = {n.node_type: n for n in nodes}
    assert (by["Claim"].claim_role, by["Claim"].modality, by["Claim"].importance) == ("interpretation", "risk", "supporting")
    assert by["Claim"].id == "CLM_" + hashlib.sha256(b"we say buy\x1fs1").hexdigest()[:16].upper()
    assert float(by["DataPoint"].value.normalized) == 1200 and by["DataPoint"].subject_ref == by["Entity"].id
    assert sorted((e.node_id[:3], e.quote) for e in made.evidence.collect()) == [("CLM", "we say buy"), ("DAT", "Revenue rose to 1,200"), ("DAT", "rose to 1,200"), ("EVT", "Revenue")]


def test_edges_proposals_and_rejections(made):
    edges = [(e.edge_type, e.source_id[:3], e.target_id[:2]) for e in made.edges.collect()]
    assert sorted(edges) == sorted([("EVIDENCED_BY", "CLM", "s1"), ("EVIDENCED_BY", "DAT", "s1"), ("EVIDENCED_BY", "EVT", "s1"), ("ABOUT", "CLM", "EN"), ("ABOUT", "DAT", "EN"), ("MEASURES", "DAT", "ME"), ("VALID_DURING", "DAT", "PE"), ("VALID_DURING", "EVT", "PE"), ("HAS_DATA", "CLM", "DA")])
    assert sorted((p.relation_type, p.assertion_level) for p in made.proposals.collect()) == [("CAUSES", "EXPLICIT"), ("SUPPORTS", "INFERRED")]
    reasons = sorted((r.kind, r.reason) for r in made.rejected.collect())
    lost, empty, loop = "unknown relation type, reference or loop", "local id, text or evidence missing", "confidence is not a number from 0 to 1"
    assert reasons == sorted([("data_point", "number not in evidence"), ("data_point", "source outside the chunk"), ("data_point", "unknown source"), ("data_point", candidates.UNLABELLED), ("data_point", empty), ("data_point", "scalar value requires normalized_decimal"), ("claim", empty), ("claim", empty), ("claim", "quote not in source"), ("relation", lost), ("relation", lost), ("relation", lost), ("relation", "explicit relation without evidence"), ("relation", loop)])


def test_nothing_in_nothing_out(spark):
    e = spark.createDataFrame
    made = candidates.register(e([], candidates.CANDIDATE), e([], candidates.RELATION), e([], "source_id string, text string"), e([], "chunk_id string, source_id string"))
    assert all(getattr(made, t).isEmpty() for t in ("nodes", "evidence", "edges", "proposals", "rejected", "links"))


def codes(rules):
    return sorted(r.code for r in reduce(DataFrame.unionByName, rules).collect())


def test_header_file_and_coverage_rules(spark):
    full = "{" + ",".join(f'"{f}":1' for f in validation.ROOT_FIELDS) + "}"
    heads = spark.createDataFrame([("g1", full, "1", "h"), ("g2", "{}", "0", "h")], "graph_id string, json string, schema_version string, state_hash string")
    assert codes(validation.header_rules(heads, "1", spark.createDataFrame([("g1", "h")], "graph_id string, computed string"))) == ["ROOT_FIELDS", "SCHEMA_VERSION", "STATE_HASH"]
    docs = spark.createDataFrame([("a", "/a", hashlib.sha256(b"x").hexdigest()), ("b", "/b", "0"), ("c", "/c", "0")], "id string, local_path string, sha256 string")
    assert codes(validation.file_rules(docs, spark.createDataFrame([("/a", b"x"), ("/b", b"y")], "local_path string, content binary"))) == ["SOURCE_FILE_EXISTS", "SOURCE_FILE_HASH"]
    sources = spark.createDataFrame([("s", "OPAQUE"), ("t", "EXTRACTED")], "id string, processing_status string")
    nodes, ev = spark.createDataFrame([("n", "Claim"), ("m", "Event"), ("e", "Entity")], "id string, node_type string"), spark.createDataFrame([("n",), ("n",)], "node_id string")
    schema = "graph_id string, status_counts map<string,long>, terminal long, evidence_coverage double"
    assert codes(validation.coverage_rules(sources, nodes, ev, spark.createDataFrame([("g", {"OPAQUE": 1, "EXTRACTED": 1}, 2, 0.5)], schema))) == []
    assert codes(validation.coverage_rules(sources, nodes, ev, spark.createDataFrame([("g", {"OPAQUE": 2}, 1, 1.0)], schema))) == ["COVERAGE_EVIDENCE", "COVERAGE_STATUS_COUNTS", "COVERAGE_STATUS_COUNTS", "COVERAGE_TERMINAL"]
    errors, warnings = spark.createDataFrame([], "code string"), spark.createDataFrame([("w",)], "code string")
    assert tuple(validation.report(errors, warnings).first()) == ("PASS", 0, 1)


def test_agenda_checks_and_report(spark):
    e = spark.createDataFrame
    nodes = e([("p", "Proposition", "reportable"), ("q", "Proposition", "reportable"), ("x", "ReportSpan", None), ("y", "ReportSpan", None), ("z", "ReportSpan", None), ("s", "Section", None)], "id string, node_type string, status string")
    edges = e([("x", "EXPRESSES", "p"), ("y", "EXPRESSES", "p"), ("y", "EXPRESSES", "q"), ("p", "ANSWERS", "s")], "source_id string, edge_type string, target_id string")
    held = e([("p",)], "id string")
    assert sorted(map(tuple, agenda.graph_errors(nodes, edges, held).collect())) == [("edge type", "p ANSWERS s"), ("not traceable", "q"), ("span of a claim that does not hold", "y"), ("span without claim", "z")]
    spoken = agenda.sentences(e([("a", 1, "One.", ["p"]), ("b", 1, "Two.", ["q", "p"])], "section_id string, seq int, text string, claims array<string>"), e([("p", 7), ("q", 3), ("q", 7)], "claim_id string, evidence_id int"))
    lines = agenda.report_lines(e([("b", "Second", 2), ("a", "First", 1)], "section_id string, title string, place int"), spoken, e([(3, "t", "u", "q3"), (7, "t", None, "q7"), (9, "t", "u", "unused")], "evidence_id int, title string, url string, quote string"))
    assert [r.line for r in lines.orderBy("part", "place", "seq").collect()] == ["## First", "One.[7]", "## Second", "Two.[3][7]", "[3] t u q3", "[7] t q7"]
    facts = e([("q", "a", False, 9.0, True, 1), ("q", "b", True, 0.0, False, 1), ("q", "c", False, 9.0, False, 5), ("q", "d", False, 0.0, True, 9)], "question_id string, id string, priority boolean, score double, is_document boolean, period_end int")
    assert [r.id for r in agenda.question_facts(facts).orderBy("rank").collect()] == ["b", "a", "c", "d"]  # a score of 0 is no reason to leave a fact out
    calls = e([("verify", 1.5, 10), ("verify", None, 5)], "stage string, seconds double, tokens long")
    assert tuple(agenda.call_totals(calls).first()) == ("verify", 2, 1.5, 15)
    firms = e([("f", "2020-01-01")], "id string, day string").selectExpr("id", "cast(day as date) listed_on")
    assert agenda.listed(firms, "2020-01-01").count() == 1
    with pytest.raises(Exception, match="not listed"):
        agenda.listed(firms, "2019-12-31").collect()
    hits = e([("u", None), (" ", "l"), (None, "")], "url string, link string")
    assert [r.url for r in landed.search_hits(hits).collect()] == ["u", "l"]
    assert sorted(map(tuple, views.nodes_of_sources(e([("s", "n"), ("s", "m"), ("s", "n")], "source_id string, node_id string")).collect())) == [("s", "m", 1), ("s", "n", 2)]
