"""Groups of queries whose tasks once held more the larger the input was: partitions follow the number of rows."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import facts, graph, payload, tables
from ledgerloom.plans import catalogue, rounds


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(rounds, "SPREAD_ROWS", 20)


def most(df):
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_conflicts(spark, small):
    rows = [(i % 1000, float(i % 3) if i % 1000 < 900 else 7.0) for i in range(3000)] + [(5, None), (None, 1.0), (None, 2.0), (1, -0.0)]
    out = facts.conflicts(spark.createDataFrame(rows, "k int, value double"), ["k"])
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert {r.k: (r.facts, r.distinct_values) for r in out.collect()} == {k: (len(v), len(set(v))) for k, v in want.items() if len(set(v)) > 1}
    assert most(out) < 60


def test_trade_and_degree(spark, sf, small):
    trade = catalogue._trade(spark, sf)
    assert most(trade) < trade.count() / 20
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("c", None)], "source_id string, target_id string")
    got = {(r.id, r.out_degree, r.in_degree, r.degree) for r in graph.degree(edges).collect()}
    assert got == {("a", 2, 0, 2), ("b", 1, 3, 4), ("c", 1, 0, 1), (None, 0, 1, 1)}


def test_capacity(spark, small):
    line = "iPhone {0} 2020.{1:02} 4GB 64GB 内存容量：从 4GB 向 6GB 升级"
    blocks = [(d, q, line.format(d, q % 2 + 1)) for d in range(100) for q in range(4)] + [(0, 0, line.format(0, 1)), (0, None, line.format(0, 1))]
    out = tables.capacity(spark.createDataFrame(blocks, "doc_id int, sequence int, text string"))
    got = {(r.doc_id, r.period, r.metric, r.raw): (r.endpoint, r.mentions) for r in out.collect()}
    want = {(d, f"2020.0{p}", m, raw): (end, 2) for d in range(100) for p in (1, 2) for m, raw, end in (("内存容量", "4GB", "reported"), ("内存容量", "6GB", "after"), ("存储容量", "64GB", "reported"))}
    assert got == want
    assert most(out) < out.count() / 20


def test_node_documents(spark, small):
    """A hub and many small nodes; before, all parts of a node met in one of the session's few partitions."""
    nodes = spark.createDataFrame([(f"n{i}", "Entity") for i in range(400)] + [("hub", "Entity")], "id string, node_type string")
    proof = spark.createDataFrame([(f"n{i % 400}", i, f"q{i}") for i in range(1200)] + [("hub", i, f"h{i}") for i in range(600)], "node_id string, seq long, quote string")
    none = spark.createDataFrame([], "object_id string, item_id string, description string, status string")
    edges = spark.createDataFrame([(f"e{i:03}", f"n{i}", "hub") for i in range(400)], "id string, source_id string, target_id string")
    out = payload.node_documents(nodes, proof, none, edges, {"evidence": 2, "edges": 1})
    got = {r.id: json.loads(r.json) for r in out.collect()}
    assert len(got) == 401 and {len(d["evidence"]) for d in got.values()} == {2}
    assert [e["quote"] for e in got["hub"]["evidence"]] == ["h0", "h1"] and got["hub"]["n_evidence"] == 600 and got["hub"]["n_edges"] == 400
    assert [e["id"] for e in got["hub"]["edges"]] == ["e000"] and [e["quote"] for e in got["n7"]["evidence"]] == ["q7", "q407"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def shuffled_rows(spark):
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_node_parts_are_shuffled_once(spark, monkeypatch):
    """Before, a node's parts were dealt to shares of it, each below the limit, so that all of them were shuffled again."""
    monkeypatch.setattr(rounds, "SPREAD_ROWS", 2000)
    nodes = spark.createDataFrame([(f"n{i}", "Entity") for i in range(400)] + [("hub", "Entity"), (None, "Entity")], "id string, node_type string")
    rows = [(f"n{i % 400}", i // 2, f"q{i}") for i in range(12000)] + [("hub", i % 3000, f"h{i:04}") for i in range(6000)] + [(None, 1, "lost")]
    proof = spark.createDataFrame(rows, "node_id string, seq long, quote string").coalesce(2)
    none = spark.createDataFrame([], "object_id string, item_id string, description string, status string")
    edges = spark.createDataFrame([("e1", "n1", "n1"), (None, "n1", "hub")], "id string, source_id string, target_id string")
    before = shuffled_rows(spark)
    got = {r.id: json.loads(r.json) for r in payload.node_documents(nodes, proof, none, edges, {"evidence": 2, "edges": 1}).where("id is not null").collect()}
    assert shuffled_rows(spark) - before < 1.5 * len(rows)
    want = {}
    for i, s, q in sorted(rows[:-1], key=lambda r: (r[1], r[2])):
        want.setdefault(i, []).append(q)
    assert len(got) == 401 and all([e["quote"] for e in got[i]["evidence"]] == q[:2] and got[i]["n_evidence"] == len(q) for i, q in want.items())
    assert got["n1"]["n_edges"] == 2 and got["n1"]["edges"] == [{"source_id": "n1", "target_id": "hub"}] and got["hub"]["n_edges"] == 1
