"""Evidence of propositions along an argument graph, as sets of bits that are carried instead of (ancestor, descendant) pairs.

Evidence is numbered densely, near the proposition that holds it, and a proposition's set is rows (id, word, bits) of 64
pieces of evidence each. What rests on near ids is settled first, in passes over the rows sorted by id: in a task, a few
thousand rows at a time pass their sets on among themselves, and only edges that leave them stay. Where passes no longer
help, long chains are contracted before anything is carried along them: in each round an independent set of nodes with at
most one parent, or without children, is taken out (its own bits and its parent pass to its children), so a chain loses a
third of its nodes a round and rounds grow with the logarithm of its length. What can't be contracted, a core in which
every node has several parents or stands on a cycle, is settled by passing on only bits that are new. Then the nodes that
were taken out get their sets in reverse order, each from its parents'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..plans.rounds import drop_written, written

SETS = ["id", "word", "bits"]
#: Rounds of contraction, by which chains become a seventh as long or so, and rounds of carrying that follow, in turn.
CONTRACTIONS, CARRIES = 5, 24
#: Rows of edges and sets, sorted by id, that are settled together; the rows they make are a quarter of its square at most.
NEAR = 2048
#: Nodes above which the parents that a pass leaves meet their sets in a shuffle instead of a broadcast.
BROADCAST = 1_000_000


def numbered(grounded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grounded (id, evidence_id) as sets of bits (id, word, bits), and evidence_id, word and bit of every piece of evidence.

    Numbers follow the smallest proposition that holds a piece, so that what stands together shares words; within a
    partition they have no gaps.
    """
    held = written(grounded.select("id", "evidence_id").where("id is not null and evidence_id is not null").distinct(), "grounded")
    first = held.groupBy("evidence_id").agg(F.min("id").alias("near"))
    ordered = first.repartitionByRange("near", "evidence_id").sortWithinPartitions("near", "evidence_id")
    number = F.monotonically_increasing_id()
    numbers = written(ordered.select("evidence_id", number.alias("n")), "numbers")
    numbers = numbers.select("evidence_id", F.shiftright("n", 6).alias("word"), (F.col("n") % 64).cast("int").alias("bit"))
    return _united(held.join(numbers, "evidence_id").select("id", "word", F.expr("shiftleft(1L, bit)").alias("bits"))), numbers


def _united(sets: DataFrame) -> DataFrame:
    return sets.groupBy("id", "word").agg(F.bit_or("bits").alias("bits")).select(*SETS)


def _contracted(edges: DataFrame) -> DataFrame:
    """The nodes (id) that one round takes out, no two of them adjacent.

    edges: id, parent_id. Fit is a node with one parent at most, or without children; of adjacent fit ones, that with the
    smallest hash goes.
    """
    ends = edges.select("id", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("parent_id", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    fit = degrees.where("up <= 1 or down = 0").select("id", F.xxhash64("id").alias("h"))
    near = edges.join(fit.select("id", "h"), "id").join(fit.select(F.col("id").alias("parent_id"), F.col("h").alias("ph")), "parent_id")
    order = lambda h, i: F.struct(h, i)
    beaten = near.select(F.when(order("h", "id") < order("ph", "parent_id"), F.col("parent_id")).otherwise(F.col("id")).alias("id")).distinct()
    return fit.join(beaten, "id", "left_anti").select("id")


def _rows(edges: DataFrame, sets: DataFrame) -> DataFrame:
    null = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    rows = edges.select(F.lit("edge").alias("kind"), "id", "parent_id", null("word", sets), null("bits", sets))
    return rows.union(sets.select(F.lit("set"), "id", null("parent_id", edges), "word", "bits"))


def _state(edges: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and sets after one job has written both."""
    held = written(_rows(edges, sets), "state", by="kind")
    return held.where("kind = 'edge'").select("id", "parent_id"), held.where("kind = 'set'").select(*SETS)


def evidence_sets(parents: DataFrame, own: DataFrame) -> DataFrame:
    """(id, word, bits), each node's own sets joined with those of all it rests on. parents: id, parent_id; own: id, word, bits.

    Safe on cycles, whose nodes share their evidence; a node or parent of any id that has no set of its own counts as empty,
    rows with a null id as absent; repeated rows count once. Nothing is a pair of nodes but the given edges and those that
    stand for contracted ones, which never outnumber them. A parent of very many is a skewed key of an inner join, which
    adaptive execution splits; a node of very many parents is pre-aggregated.
    """
    edges, sets = _state(parents.select("id", "parent_id").where("id <> parent_id").distinct(), _united(own.where("id is not null")))
    return _by_passes(edges, sets, edges.count()) if isinstance(edges.schema["id"].dataType, AtomicType) else _by_rounds(edges, sets)


def _by_passes(edges: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The sets of all nodes, by passes over near ids for as long as each leaves half of the `n` edges at most."""
    if not n:
        return sets
    rows = _rows(edges, sets).select("id", "parent_id", "word", "bits")
    schema = rows.select(F.lit("").alias("kind"), "*").schema
    most, parts = NEAR, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = rows.repartitionByRange(min(n // NEAR + 1, parts), "id").sortWithinPartitions("id").mapInArrow(lambda batches: _near(batches, most), schema)
    held = written(settled, "near", by="kind")
    after, done = held.where("kind = 'edge'").select("id", "parent_id"), held.where("kind = 'done'").select(*SETS)
    left = after.count()
    if not left:
        return held.where("kind <> 'edge'").select(*SETS)
    above = written(after.select(F.col("parent_id").alias("id")).distinct(), "above")
    above = F.broadcast(above) if above.count() <= BROADCAST else above
    tops = written(done.join(above, "id", "left_semi"), "tops")
    open_sets = held.where("kind = 'set'").select(*SETS).union(tops)
    known = open_sets.select(F.col("id").alias("parent_id")).union(after.select("id")).distinct()  # other parents hold nothing
    after = written(after.join(known, "parent_id", "left_semi").select("id", "parent_id"), "edges")
    left = after.count()
    rest = _by_passes(after, open_sets, left) if left <= n / 2 else _by_rounds(after, open_sets)
    return done.union(rest.join(tops.select("id").distinct(), "id", "left_anti").select(*SETS))


def _near(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, parent_id, word, bits), sorted by id, settled about `most` at a time, cut between nodes.

    A node of more rows than that goes through as it is.
    """
    held, begun = None, False  # begun: the first node of held has had rows before
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            held = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, piece.columns, strict=True)], schema=piece.schema) if held is not None else piece
            if held.num_rows < most:
                continue
            nodes = held.column(0).dictionary_encode().indices.to_pylist()
            last = nodes.index(nodes[-1])
            if last:
                yield _settled(held.slice(0, last), begun)
                held, begun = held.slice(last), False
            else:
                yield _settled(held, True)
                held, begun = None, True
    if held is not None:
        yield _settled(held, begun)


def _settled(rows: pa.RecordBatch, begun: bool) -> pa.RecordBatch:
    """Rows with a kind once sets have passed among their nodes, from parents to children.

    A node's set holds those of its ancestors here, and its edges lead to what these rest on elsewhere: to a parent's only
    edge instead of the parent, to nothing if it has none, so edges never outnumber the given ones. Sets are `done` if no
    edge is left. On and below cycles, and for a first node that has `begun` before, nothing changes.
    """
    n, field = rows.num_rows, rows.schema.field
    both = pa.concat_arrays([rows.column(0), rows.column(1)]).dictionary_encode()
    code, words, bits = both.indices.to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()
    parents, own = {}, {}
    for i, p, w, b in zip(code[:n], code[n:], words, bits, strict=True):
        above, held = parents.setdefault(i, []), own.setdefault(i, {})
        if p is None:
            held[w] = held.get(w, 0) | b
        else:
            above.append(p)
    inside = parents.keys() - {code[0]} if begun else parents.keys()
    children, waits = {}, {}
    for i in inside:
        waits[i] = 0
        for p in parents[i]:
            if p in inside:
                children.setdefault(p, []).append(i)
                waits[i] += 1
    rests, ready = {}, [i for i in waits if not waits[i]]
    for i in ready:  # grows on the way
        held, up = own[i], set()
        for p in parents[i]:
            if p not in rests:
                up.add(p)
                continue
            for w, b in own[p].items():
                held[w] = held.get(w, 0) | b
            up |= rests[p] if len(rests[p]) < 2 else {p}
        rests[i] = up
        for c in children.get(i, ()):
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    out = []
    for i, held in own.items():
        up = rests.get(i, parents[i])
        out += [("edge", i, p, None, None) for p in up]
        kind = "set" if up or i not in rests else "done"
        out += [(kind, i, None, w, b) for w, b in held.items()]
    kinds, ids, ups, words, bits = zip(*out, strict=True) if out else ((),) * 5
    named = lambda codes: both.dictionary.take(pa.array(codes, both.indices.type))
    columns = [pa.array(kinds, pa.string()), named(ids), named(ups), pa.array(words, field(2).type), pa.array(bits, field(3).type)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", *rows.schema.names])


def _by_rounds(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of all nodes, by contraction and carrying."""
    (edges, sets), levels, done = _state(edges, _united(sets)), [], False
    while not done:
        contracted = 0
        while contracted < CONTRACTIONS and not edges.isEmpty():
            gone = written(_contracted(edges), "gone")
            if gone.isEmpty():
                break
            levels.append((edges, sets, gone))
            edges, sets = _state(*_without(edges, sets, gone))
            contracted += 1
        sets, done = _carried(edges, sets, CARRIES if contracted else None)
    parts = [sets]
    for edges, sets, gone in reversed(levels):
        known = reduce(DataFrame.union, parts)
        rests, own_then = edges.join(gone, "id", "left_semi"), sets.join(gone, "id", "left_semi")
        got = rests.join(known.select(F.col("id").alias("parent_id"), "word", "bits"), "parent_id").select(*SETS)
        parts.append(written(_united(got.union(own_then)), "sets"))
        drop_written(gone)
    return reduce(DataFrame.union, parts)


def _without(edges: DataFrame, sets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and sets once the nodes `gone` have passed their sets and their parents to their children."""
    above = gone.select(F.col("id").alias("parent_id"))
    over = edges.join(above, "parent_id", "left_semi")  # the edges of those that rest on the ones taken out
    passed = over.join(sets.select(F.col("id").alias("parent_id"), "word", "bits"), "parent_id").select(*SETS)
    rests = edges.join(gone, "id", "left_semi")
    lifted = over.join(rests.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("up")), "parent_id").select("id", F.col("up").alias("parent_id"))
    kept = edges.join(gone, "id", "left_anti").join(above, "parent_id", "left_anti").select("id", "parent_id")
    return kept.union(lifted.where("id <> parent_id")).distinct(), _united(sets.join(gone, "id", "left_anti").union(passed))


def _carried(edges: DataFrame, sets: DataFrame, most: int | None) -> tuple[DataFrame, bool]:
    """Sets after bits have gone down the edges `most` times, or until none is new, and whether none is.

    Each round passes on only the bits that were new in the last.
    """
    parts, rounds = [sets], 0
    while most is None or rounds < most:
        got = _united(edges.join(parts[-1].select(F.col("id").alias("parent_id"), "word", "bits"), "parent_id").select(*SETS))
        known = _united(reduce(DataFrame.union, parts)).select("id", "word", F.col("bits").alias("had"))
        fresh = got.join(known, ["id", "word"], "left").select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0)))).alias("bits"))
        new = written(fresh.where("bits <> 0"), "new")
        if new.isEmpty():
            return _together(parts), True
        parts, rounds = [*parts, new], rounds + 1
        if len(parts) > CARRIES:
            parts = [_together(parts[:-1]), new]
    return _together(parts), False


def _together(parts: list[DataFrame]) -> DataFrame:
    return written(_united(reduce(DataFrame.union, parts)), "sets") if len(parts) > 1 else parts[0]


def bits_set(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def sizes(sets: DataFrame) -> DataFrame:
    """id and n, the number of pieces of evidence in its set."""
    return sets.groupBy("id").agg(F.sum(bits_set(F.col("bits"))).alias("n"))


def members(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """(id, evidence_id) of sets: for chosen ids, as it gives a row for each piece of evidence of each."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    return sets.select("id", "word", F.explode(places).alias("bit")).join(numbers, ["word", "bit"]).select("id", "evidence_id")


def group_sets(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """The united sets of groups (group_id, id), as rows (id, word, bits) with the group's id."""
    return _united(groups.select("group_id", "id").distinct().join(sets, "id").select(F.col("group_id").alias("id"), "word", "bits"))


def section_claims(asked: DataFrame, answers: DataFrame, held: DataFrame, most: int = 16) -> DataFrame:
    """section_id, place and id of the claims a section may state: the first `most` that hold and answer one of its questions.

    asked: section_id, question_id, place (the question's); answers: question_id, id, seq; held: id. A claim that answers
    several questions stands where it comes first.
    """
    rows = asked.join(answers, "question_id").join(held.select("id"), "id", "left_semi")
    first = rows.groupBy("section_id", "id").agg(F.min(F.struct("place", "seq")).alias("at"))
    turn = F.row_number().over(Window.partitionBy("section_id").orderBy("at", "id"))
    return first.select("section_id", "id", turn.alias("place")).where(F.col("place") <= most)


def section_evidence(sets: DataFrame, numbers: DataFrame, claims: DataFrame, most: int = 20) -> DataFrame:
    """The evidence baseline: section_id, evidence_id, place of the first `most` pieces, by id, on which its claims rest."""
    united = group_sets(sets, claims.select(F.col("section_id").alias("group_id"), "id"))
    rows = members(united, numbers).select(F.col("id").alias("section_id"), "evidence_id")
    turn = F.row_number().over(Window.partitionBy("section_id").orderBy("evidence_id"))
    return rows.withColumn("place", turn).where(F.col("place") <= most)
