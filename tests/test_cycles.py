"""Strongly connected components, connected parts and the online order against brute force."""

import random
import time

import pytest

from ledgerloom.operators import cycles, graph


def reach(edges):
    out, nodes = {}, {x for e in edges for x in e}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        found[n] = seen
    return found


def brute(edges):
    far = reach(edges)
    return {(n, min(m for m in far[n] if n in far[m])) for n in far if n in far[n]}


def found(spark, edges):
    return {tuple(r) for r in cycles.components(spark.createDataFrame(edges, "source_id long, target_id long")).collect()}


def shapes():
    rng = random.Random(8)
    two_rings = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (7, 0), (9, 9), (9, 1)]
    dense = [(a, b) for a in range(20, 32) for b in rng.sample(range(20, 32), 4) if a != b] + [(31, 40), (40, 41), (41, 20), (41, 42)]
    sparse = [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(75)]
    apart = [(a, b) for base in (200, 220) for a in range(base, base + 8) for b in rng.sample(range(base, base + 8), 4) if a != b] + [(201, 221)]
    return two_rings + dense + sparse + apart


def test_components_against_brute_force(spark):
    edges = shapes()
    assert found(spark, edges + edges[:4] + [(None, 1), (1, None)]) == brute(edges)
    assert found(spark, []) == set() and found(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]) == set() and found(spark, [(5, 5)]) == {(5, 5)}


def test_rounds_follow_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds, keep = [], cycles._taken
    monkeypatch.setattr(cycles, "_taken", lambda e: rounds.append(1) or keep(e))
    chain = [(i, i + 1) for i in range(5000)]
    assert found(spark, chain) == set()
    assert len(rounds) <= 26  # ln 5000 / ln 1.5 = 21
    ring = [(i, (i + 1) % 700) for i in range(700)] + [(1000 + i, 1001 + i) for i in range(300)] + [(1300, 5)]
    assert found(spark, ring) == {(i, 0) for i in range(700)}


def test_weak_parts(spark):
    edges = shapes() + [(i, i + 1) for i in range(300, 400)]
    got = dict(map(tuple, cycles.weak_parts(spark.createDataFrame(edges + [(None, 3)], "source_id long, target_id long")).collect()))
    far = reach(edges + [(b, a) for a, b in edges])
    assert got == {n: min(far[n] | {n}) for n in far}


def greedy(edges):
    out, flags = {}, []
    for s, t in edges:
        seen, todo = {t}, [t]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        flags.append(s not in seen)
        if flags[-1]:
            out.setdefault(s, set()).add(t)
    return flags


@pytest.mark.parametrize("seed", range(30))
def test_online_order_admits_as_the_plain_search(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(120)]
    order = graph.Topological()
    assert [order.add(s, t) for s, t in edges] == greedy(edges)
    assert all(order.place[a] < order.place[b] for a in order.down for b in order.down[a])


def test_online_order_is_quick():
    rng = random.Random(1)
    rank = rng.sample(range(50_000), 50_000)
    took = {}
    for n in (20_000, 80_000):
        edges, order = [tuple(sorted(rng.sample(range(50_000), 2), key=rank.__getitem__)) for _ in range(n)], graph.Topological()
        began = time.perf_counter()
        assert all(order.add(s, t) for s, t in edges)
        took[n] = time.perf_counter() - began
    assert took[80_000] < 20


def test_admission_by_parts(spark):
    rng = random.Random(3)
    rows = [(g, i, f"n{rng.randrange(12)}{'x' * (i % 2)}", f"n{rng.randrange(12)}{'x' * (i % 2)}", i % 3 == 0, rng.randrange(4) / 4) for g in range(3) for i in range(60)]
    rel = spark.createDataFrame(rows, "graph_id long, proposal_id long, source_id string, target_id string, explicit boolean, confidence double")
    whole, parts = (sorted(map(tuple, graph.admit_acyclic(rel, split).collect())) for split in (False, True))
    assert whole == parts and 0 < sum(r[-1] for r in whole) < len(rows)
    want = []
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (not r[4], -r[5], r[1]))
        want += [(g, r[1], r[2], r[3], f) for r, f in zip(own, greedy([(r[2], r[3]) for r in own]), strict=True)]
    assert whole == sorted(want)


def test_admission_takes_nulls_and_nan_last_over_small_batches(spark):
    """Graphs that run over batches' ends, a graph without id, confidences that are null or no number, a repeated id."""
    from ledgerloom.operators import graph

    rng, rows = random.Random(7), []
    for g in [*range(30), None]:
        for i in range(rng.randrange(1, 40)):
            sure = rng.choice([0.5, 0.9, None, float("nan")])
            rows.append((g, f"p{i // 2 if i % 9 == 0 else i}", rng.randrange(8), rng.randrange(8), rng.choice([True, False, None]), sure))
    df = spark.createDataFrame(rows, "graph_id long, proposal_id string, source_id long, target_id long, explicit boolean, confidence double")
    df = df.dropDuplicates(["graph_id", "proposal_id"])
    want = {}
    last = lambda x: x is None or x != x
    rank = lambda r: (last(r.explicit), not r.explicit, last(r.confidence), 0 if last(r.confidence) else -r.confidence, r.proposal_id)
    by = {}
    for r in df.collect():
        by.setdefault(r.graph_id, []).append(r)
    for g, rs in by.items():
        down = {}
        for r in sorted(rs, key=rank):
            todo, seen = [r.target_id], {r.target_id}
            while todo:
                for x in down.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            want[g, r.proposal_id] = r.source_id not in seen
            if want[g, r.proposal_id]:
                down.setdefault(r.source_id, []).append(r.target_id)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        plan = graph.admit_acyclic(df)
        assert {(r.graph_id, r.proposal_id): r.admitted for r in plan.collect()} == want
        assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
