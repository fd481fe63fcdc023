"""Evidence sets against brute-force reachability, the fused validator against single mutations of a sound graph."""

import random

import pytest

from ledgerloom.operators import audit, closure
from ledgerloom.plans.rounds import written


def reach(edges, ids):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out[i] = seen
    return out


def check_sets(spark, edges, grounded):
    parents = spark.createDataFrame(edges, "id string, parent_id string")
    own, numbers = closure.numbered(spark.createDataFrame(grounded, "id string, evidence_id string"))
    sets = closure.evidence_sets(parents, own)
    got = {(r.id, r.evidence_id) for r in closure.members(sets, numbers).collect()}
    held = {}
    for i, e in grounded:
        held.setdefault(i, set()).add(e)
    ids = {x for e in edges for x in e if x is not None} | set(held)
    good = [(a, b) for a, b in edges if a is not None and b is not None]
    want = {(i, e) for i, seen in reach(good, ids).items() for p in seen for e in held.get(p, ())}
    assert got == want
    assert {r.id: r.n for r in closure.sizes(sets).collect()} == {i: sum(1 for j, _ in want if j == i) for i, _ in want}


def test_sets_of_chains_diamonds_cycles_and_hubs(spark):
    rng = random.Random(4)
    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 90)]
    hub = [(f"h{i}", "hub") for i in range(40)] + [("sink", f"h{i}") for i in range(40)] + [("hub", "c80")]
    ring = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("x", "r1"), ("r2", "y"), ("s", "s")]
    core = [(f"k{i}", f"k{j}") for i in range(12) for j in rng.sample(range(12), 3) if i != j]
    mess = [(f"m{rng.randrange(60)}", f"m{rng.randrange(60)}") for _ in range(90)]
    edges = chain + hub + ring + core + mess + [("c5", None), (None, "c1"), chain[3], chain[3]]
    ids = sorted({x for e in edges for x in e if x})
    grounded = [(i, f"e{rng.randrange(150)}") for i in ids for _ in range(rng.randrange(3))] + [("c0", "first"), ("r1", "ring"), ("alone", "own")]
    check_sets(spark, edges, grounded + grounded[:5])


def test_sets_without_edges_or_evidence(spark):
    check_sets(spark, [], [("a", "e1")])
    check_sets(spark, [("a", "b")], [])


def test_near_chains_settle_without_rounds(spark, monkeypatch):
    """Before, the rounds of a chain of 64 wrote dozens of folders for any number of rows."""
    labels = []
    monkeypatch.setattr(closure, "written", lambda df, label="round", by=None: labels.append(label) or written(df, label, by))
    edges = [(g * 64 + i, g * 64 + i - 1) for g in range(30) for i in range(1, 64)]
    parents = spark.createDataFrame(edges, "id long, parent_id long")
    own, _ = closure.numbered(spark.createDataFrame([(i, 3 * i) for i in range(30 * 64) if i % 64], "id long, evidence_id long"))
    assert {r.id: r.n for r in closure.sizes(closure.evidence_sets(parents, own)).collect()} == {i: i % 64 for i in range(30 * 64) if i % 64}
    assert "gone" not in labels and len(labels) <= 14


@pytest.mark.parametrize("near", [1, 5, 40, 4096])
def test_sets_whatever_settles_together(spark, monkeypatch, near):
    monkeypatch.setattr(closure, "NEAR", near)
    rng = random.Random(near)
    edges = [(f"n{i:03}", f"n{i - d:03}") for i in range(1, 80) for d in (1, 2, 7) if i >= d and rng.random() < 0.6]
    edges += [("n010", "n012"), ("n070", "n020"), ("n020", "n075"), ("z1", "n050"), ("z2", "z1"), ("z2", "a0")] + [("big", f"n{i:03}") for i in range(0, 60, 2)]
    grounded = [(f"n{i:03}", f"e{rng.randrange(200)}") for i in range(80) for _ in range(rng.randrange(3))] + [("a0", "top"), ("alone", "x")] + [("big", f"b{i}") for i in range(100)]
    check_sets(spark, edges, grounded)


def test_section_claims_and_baseline(spark):
    asked = spark.createDataFrame([("s1", "q1", 1), ("s1", "q2", 2), ("s2", "q3", 1)], "section_id string, question_id string, place int")
    answers = spark.createDataFrame([("q2", "p2", 1), ("q1", "p1", 2), ("q1", "p9", 1), ("q2", "p1", 9), ("q3", "p3", 1)], "question_id string, id string, seq int")
    held = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string")
    claims = closure.section_claims(asked, answers, held)
    assert sorted((r.section_id, r.id, r.place) for r in claims.collect()) == [("s1", "p1", 1), ("s1", "p2", 2), ("s2", "p3", 1)]
    own, numbers = closure.numbered(spark.createDataFrame([("p1", "e3"), ("p2", "e1"), ("p2", "e3"), ("p0", "e2")], "id string, evidence_id string"))
    sets = closure.evidence_sets(spark.createDataFrame([("p1", "p0")], "id string, parent_id string"), own)
    out = closure.section_evidence(sets, numbers, claims, 2)
    assert sorted((r.section_id, r.evidence_id, r.place) for r in out.collect()) == [("s1", "e1", 1), ("s1", "e2", 2)]


NODE = "graph_id string, id string, node_type string, label string, assertion_level string, importance string, claim_role string, subject_ref string, metric_ref string, period_ref string, value struct<kind:string,raw:string,normalized_decimal:string,range_low:string,range_high:string,scale:string>, premise_node_ids array<string>, conclusion_claim_ids array<string>, evidence array<struct<source_object_id:string,quote:string,quote_sha256:string,match_mode:string>>, code string, kind string"
EDGE = "graph_id string, id string, edge_type string, source_id string, target_id string, assertion_level string, status string, verdict string, verdict_confidence double, has_evidence boolean, key string"
SOURCE = "graph_id string, id string, document_id string, raw_text string, normalized_text string, sha256 string, processing_status string"
HEADER = "graph_id string, json string, schema_version string, state_hash string, computed string, document_id string, local_path string, sha256 string, status_counts map<string,long>, terminal long, evidence_coverage double"


def sha(s):
    import hashlib

    return hashlib.sha256(s.encode()).hexdigest()


def sound():
    """A graph without faults, as rows that a test may change."""
    text = "Revenue rose to 12 units in 2024"
    proof = [("S1", "to 12 units", sha("to 12 units"), "exact")]
    node = lambda i, t, **k: {"graph_id": "g", "id": i, "node_type": t, "label": "x", "assertion_level": "EXPLICIT"} | k
    edge = lambda i, t, a, b, **k: {"graph_id": "g", "id": i, "edge_type": t, "source_id": a, "target_id": b, "assertion_level": "EXPLICIT", "status": "active", "has_evidence": True} | k
    from ledgerloom.operators.validation import ROOT_FIELDS

    return {
        "headers": [{"graph_id": "g", "json": "{" + ",".join(f'"{f}":1' for f in ROOT_FIELDS) + "}", "schema_version": "v1", "state_hash": "h", "computed": "h", "document_id": "D", "local_path": "f", "sha256": sha("body"), "status_counts": {"EXTRACTED": 1}, "terminal": 1, "evidence_coverage": 1.0}],
        "files": [{"local_path": "f", "content": b"body"}],
        "sources": [{"graph_id": "g", "id": "S1", "document_id": "D", "raw_text": text, "normalized_text": text, "sha256": sha(text), "processing_status": "EXTRACTED"}],
        "nodes": [
            node("C1", "Claim", evidence=proof),
            node("C2", "Claim", evidence=proof, importance="core", claim_role="forecast"),
            node("P1", "DataPoint", evidence=proof, subject_ref="E1", metric_ref="M1", period_ref="T1", value=("scalar", "12", "12", None, None, "1")),
            node("E1", "Entity"), node("M1", "Metric"), node("T1", "Period"),
            node("R1", "ReasoningStep", premise_node_ids=["C1"], conclusion_claim_ids=["C2"]),
        ],
        "edges": [
            edge("e1", "EVIDENCED_BY", "C1", "S1"), edge("e2", "EVIDENCED_BY", "C2", "S1"), edge("e3", "EVIDENCED_BY", "P1", "S1"),
            edge("e4", "SUPPORTS", "C1", "C2"), edge("e5", "PREMISE_OF", "C1", "R1"), edge("e6", "CONCLUDES", "R1", "C2"),
        ],
    }


def codes(spark, g, schema=None):
    of = lambda t, ddl: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in names(ddl)) for r in g[t]], ddl)
    found, seen = audit.audit(of("headers", HEADER), of("files", "local_path string, content binary"), of("sources", SOURCE), of("nodes", NODE), of("edges", EDGE), "v1", schema)
    rows = found.collect()
    n = seen.get
    assert n["errors"] == sum(r.code not in audit.WARNINGS for r in rows) and n["errors"] + n["warnings"] == len(rows)
    return sorted({(r.code, r.object_id) for r in rows}, key=str)


def names(ddl):
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def change(table, row, **values):
    def apply(g):
        g[table][row] |= values

    return apply


def drop(table, row):
    return lambda g: g[table].pop(row)


MUTATIONS = [
    (lambda g: None, []),
    (change("headers", 0, schema_version="v0"), [("SCHEMA_VERSION", "g")]),
    (change("headers", 0, json="{}"), [("ROOT_FIELDS", "g")]),
    (change("headers", 0, state_hash=None), [("STATE_HASH", "g")]),
    (drop("files", 0), [("SOURCE_FILE_EXISTS", "D")]),
    (change("files", 0, content=b"other"), [("SOURCE_FILE_HASH", "D")]),
    (change("headers", 0, status_counts=None), [("COVERAGE_STATUS_COUNTS", "g")]),
    (change("headers", 0, status_counts={"EXTRACTED": 1, "OPAQUE": 0}), [("COVERAGE_STATUS_COUNTS", "g")]),
    (change("headers", 0, terminal=None), [("COVERAGE_TERMINAL", "g")]),
    (change("nodes", 0, evidence=None, assertion_level="INFERRED"), [("COVERAGE_EVIDENCE", "g"), ("EVIDENCE_EDGE_PARITY", "C1")]),
    (change("edges", 3, id="C1"), [("UNIQUE_IDS", "C1")]),
    (change("edges", 4, id=None), [("EDGE_IDS", None)]),
    (change("edges", 5, edge_type="PREMISE_OF"), [("REASONING_CONCLUSION", "R1")]),
    (change("edges", 0, target_id="S9"), [("EVIDENCE_EDGE_PARITY", "C1"), ("EVIDENCE_TARGET", "e1")]),
    (change("edges", 3, assertion_level="INFERRED", verdict="accept", verdict_confidence=0.64), [("UNVERIFIED_INFERRED_EDGE", "e4")]),
    (change("edges", 3, assertion_level="INFERRED", verdict="accept", verdict_confidence=0.65), []),
    (change("edges", 3, has_evidence=None), [("EXPLICIT_RELATION_EVIDENCE", "e4")]),
    (change("edges", 3, status="inactive"), [("CORE_CLAIM_WITHOUT_ARGUMENT", "C2")]),
    (change("nodes", 1, evidence=[("S1", "to 13 units", sha("to 13 units"), "exact")]), [("EVIDENCE_QUOTE", "C2")]),
    (change("nodes", 1, evidence=[("S1", "to12units", sha("to12units"), "whitespace_normalized")]), []),
    (change("nodes", 1, evidence=[("S1", "to 12 units", sha("x"), None)]), [("EVIDENCE_QUOTE_HASH", "C2")]),
    (change("nodes", 2, value=("range", "12", None, "5", "3", None)), [("DATA_RANGE", "P1")]),
    (change("nodes", 2, value=("scalar", "13", "13", None, None, "x")), [("DATA_DECIMAL", "P1"), ("DATA_RAW_EVIDENCE", "P1")]),
    (change("nodes", 2, period_ref=None, subject_ref="M1"), [("DATA_CONTEXT", "P1")]),
    (change("nodes", 3, node_type="Thing", label=" "), [("DATA_CONTEXT", "P1"), ("NODE_TYPE", "E1")]),
    (change("nodes", 6, premise_node_ids=None), [("REASONING_SHAPE", "R1")]),
    (lambda g: g["edges"].append(g["edges"][3] | {"id": "e9", "source_id": "C2", "target_id": "C1"}), [("ARGUMENT_DAG", "C1"), ("ARGUMENT_DAG", "C2")]),
    (lambda g: g["edges"].append(g["edges"][3] | {"id": "e9"}), [("DUPLICATE_EDGE", " k SUPPORTS C1 C2")]),
]


@pytest.mark.parametrize("at", range(0, len(MUTATIONS), 4))
def test_each_fault_earns_its_code(spark, at):
    """Four graphs at once, so that each is also a test that graphs are looked up apart."""
    parts, want = {}, []
    for i, (mutate, expected) in enumerate(MUTATIONS[at : at + 4]):
        g = sound()
        mutate(g)
        for t, rows in g.items():
            parts.setdefault(t, []).extend(r | ({"graph_id": f"g{i}"} if t != "files" else {"local_path": f"f{i}"}) | ({"local_path": f"f{i}"} if t == "headers" else {}) for r in rows)
        want += [(c, f"g{i}" if o == "g" else o) for c, o in expected]
    assert codes(spark, parts) == sorted(set(want), key=str)


def test_schema_document_and_empty_graph(spark):
    g = sound()
    assert codes(spark, g, '{"properties":{"schema_version":{"const":"v2"}}}') == [("SCHEMA_DOCUMENT_VERSION", "g")]
    assert codes(spark, g | {"sources": [], "nodes": [], "edges": [], "headers": [g["headers"][0] | {"status_counts": {}, "terminal": 0}]}) == []


def test_every_table_is_scanned_twice_at_most(spark, tmp_path, monkeypatch):
    g, at = sound(), {}
    for t, ddl in (("headers", HEADER), ("files", "local_path string, content binary"), ("sources", SOURCE), ("nodes", NODE), ("edges", EDGE)):
        spark.createDataFrame([tuple(r.get(c.split()[0]) for c in names(ddl)) for r in g[t]], ddl).write.parquet(f"{tmp_path}/{t}_table")
        at[t] = spark.read.parquet(f"{tmp_path}/{t}_table")
    plans, keep = [], audit.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(audit, "written", lambda df, *a, **k: plans.append(plan(df)) or keep(df, *a, **k))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found, _ = audit.audit(at["headers"], at["files"], at["sources"], at["nodes"], at["edges"], "v1")
    assert found.count() == 0
    whole = "\n".join([*plans, plan(found)])
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert {t: whole.count(f"/{t}_table]") for t in at} == {"headers": 1, "files": 1, "sources": 2, "nodes": 1, "edges": 1}


def test_items_are_written_whole_and_names_met_once(spark, monkeypatch):
    """Before, items were exploded and sorted into folders to be written, and names were grouped three times."""
    g, made, keep = sound(), [], audit.written
    monkeypatch.setattr(audit, "written", lambda df, *a, **k: made.append((keep(df, *a, **k), a, k)) or made[-1][0])
    monkeypatch.setattr("ledgerloom.plans.rounds.SPREAD_ROWS", 3)
    g["nodes"].append(g["nodes"][3])  # a hub named twice, and met by many references
    g["edges"] += [g["edges"][4] | {"id": f"h{i}", "edge_type": "ABOUT", "source_id": "E1", "target_id": "E1" if i % 2 else f"lost{i}"} for i in range(40)]
    of = lambda t, ddl: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in names(ddl)) for r in g[t]], ddl)
    found, _ = audit.audit(of("headers", HEADER), of("files", "local_path string, content binary"), of("sources", SOURCE), of("nodes", NODE), of("edges", EDGE), "v1")
    got = sorted((r.code, r.object_id, r.detail) for r in found.collect())
    lost = [("EDGE_TARGET", f"h{i}", None) for i in range(0, 40, 2)]
    assert got == sorted([("UNIQUE_IDS", "E1", None), ("NODE_IDS", "E1", None), ("DUPLICATE_EDGE", " k ABOUT E1 E1", None), *lost], key=str)
    items, a, k = made[0]
    assert len(made) == 1 and a == ("items",) and not k
    assert items.count() == 1 + len(g["sources"]) + len(g["nodes"]) + len(g["edges"])
    whole = found._jdf.queryExecution()
    met = [x for x in whole.executedPlan().toString().splitlines() if "FullOuter" in x]
    assert met and all("ShuffledHashJoin" in x and "BuildRight" in x for x in met)  # a sort-merge join would hold all references to the hub
    assert sum("Aggregate [graph_id" in x and x.count("count(") >= 7 for x in whole.optimizedPlan().toString().splitlines()) == 1
