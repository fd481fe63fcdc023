"""Typed property graphs as DataFrames: nodes (id, node_type, ...) and edges (source_id, edge_type, target_id, ...)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import written
from .cycles import weak_parts

#: Fixed vocabularies.
NODE_TYPES = ("Entity", "Metric", "Period", "DataPoint", "Claim", "Event", "ReasoningStep", "Assumption")
EDGE_TYPES = ("EVIDENCED_BY", "ABOUT", "MEASURES", "VALID_DURING", "HAS_DATA", "SUPPORTS", "CONTRADICTS", "CAUSES", "AFFECTS", "DEPENDS_ON", "PREMISE_OF", "CONCLUDES", "ASSUMES", "SAME_AS")
ARGUMENT_TYPES = ("SUPPORTS", "CONTRADICTS", "CAUSES", "AFFECTS", "DEPENDS_ON")
#: Endpoint types of the agenda profile's edges.
AGENDA_EDGES = {"CONTAINS": ("Source", "EvidenceUnit"), "ABOUT": ("Proposition", "Entity"), "GROUNDED_IN": ("Proposition", "EvidenceUnit"), "CALCULATED_FROM": ("Proposition", "Proposition"), "PREMISE_OF": ("Proposition", "Proposition"), "ANSWERS": ("Proposition", "Question"), "IN_SECTION": ("Question", "Section"), "SUBQUESTION_OF": ("Question", "Question"), "SUBSECTION_OF": ("Section", "Section"), "EXPRESSES": ("ReportSpan", "Proposition")}
VIEWS = {"semantic": ("Source", "EvidenceUnit", "Entity", "Proposition"), "agenda": ("Section", "Question", "Proposition")}
ACCEPT_AT = 0.65


def induced(nodes: DataFrame, edges: DataFrame, types: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types and the edges with both ends among them."""
    kept = nodes.where(F.col("node_type").isin(*types))
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, inside


def view(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    if name not in VIEWS:
        raise ValueError(f"Unknown view {name!r}")
    return induced(nodes, edges, VIEWS[name])


def dangling(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Edges (with code) whose source or target is missing; EVIDENCED_BY must end at a source."""
    ids = nodes.select("id")
    no_source = edges.join(ids, edges.source_id == ids.id, "left_anti").withColumn("code", F.lit("EDGE_SOURCE"))
    plain = edges.where("edge_type <> 'EVIDENCED_BY'")
    no_target = plain.join(ids, plain.target_id == ids.id, "left_anti").withColumn("code", F.lit("EDGE_TARGET"))
    out = no_source.unionByName(no_target)
    if sources is not None:
        cites, places = edges.where("edge_type = 'EVIDENCED_BY'"), sources.select("id")
        out = out.unionByName(cites.join(places, cites.target_id == places.id, "left_anti").withColumn("code", F.lit("EVIDENCE_TARGET")))
    return out


def mistyped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Agenda edges whose end types differ from the vocabulary's, or whose type is unknown."""
    kinds = F.create_map(*[F.lit(x) for k, v in AGENDA_EDGES.items() for x in (k, f"{v[0]}>{v[1]}")])
    s, t = nodes.select(F.col("id").alias("source_id"), F.col("node_type").alias("source_type")), nodes.select(F.col("id").alias("target_id"), F.col("node_type").alias("target_type"))
    return edges.join(s, "source_id", "left").join(t, "target_id", "left").where(~F.concat_ws(">", "source_type", "target_type").eqNullSafe(F.try_element_at(kinds, F.col("edge_type"))))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per (type, source, target): the first by seq."""
    return edges.groupBy("edge_type", "source_id", "target_id").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("edge_type", "source_id", "target_id")]), "seq").alias("x")).select("edge_type", "source_id", "target_id", "x.*")


def degree(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every end."""
    end = lambda c, o: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
    ends = edges.select(F.inline(F.array(end("source_id", 1), end("target_id", 0))))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, types: Iterable[str] | None = None) -> DataFrame:
    """(id, hops) of all nodes within `depth` undirected steps of the seeds.

    The edges are written once, and each hop follows only from the nodes that were new in the last, so a hop costs its
    frontier's edges and the plan doesn't grow.
    """
    if types is not None:
        edges = edges.where(F.col("edge_type").isin(*types))
    held = written(edges.select("source_id", "target_id"), "edges") if depth > 1 else edges.select("source_id", "target_id")
    new, found = seeds.select("id", F.lit(0).alias("hops")).distinct(), []
    for hop in range(1, depth + 1):
        found.append(new)
        seen, ids = reduce(DataFrame.union, found).select("id"), new.select("id")
        down = held.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
        up = held.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
        new = down.union(up).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hops"))
        new = written(new, "hop") if hop < depth else new
    return reduce(DataFrame.union, [*found, new])


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Distinct (source_id, target_id, depth) reachable pairs, safe on cycles; depth is the shortest.

    start: ids from which pairs are wanted; without it, pairs from every node. Each round joins only the pairs found last
    with the edges, until one finds no new pair. What was found is kept in tables each of which is more than twice as large
    as the next, so neither the plan nor the number of files grows with the depth.
    """
    steps = written(edges.select("source_id", "target_id").distinct())
    hop = steps.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("far"))
    first = steps if start is None else steps.join(start.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    new, depth, known = written(first.withColumn("depth", F.lit(1))), 1, []
    while size := new.count():
        known.append((size, new))
        while len(known) > 1 and known[-2][0] <= 2 * known[-1][0]:
            (m, late), (n, early) = known.pop(), known.pop()
            known.append((m + n, written(early.union(late))))
        depth += 1
        reach = new.join(hop, "target_id").select("source_id", F.col("far").alias("target_id")).distinct()
        found = reduce(DataFrame.union, [x for _, x in known])
        new = written(reach.join(found, ["source_id", "target_id"], "left_anti").withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.union, [x for _, x in known]) if known else new


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Ids left after nodes without outgoing edges are peeled off again and again; empty iff there is no cycle."""
    left = written(edges.select("source_id", "target_id").distinct())
    count = left.count()
    while count:
        left = written(left.join(left.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id"))
        after = left.count()
        if after == count:
            break
        count = after
    return left.select(F.col("source_id").alias("id")).distinct()


def reportable(nodes: DataFrame, parents: DataFrame, leaves: DataFrame) -> DataFrame:
    """Ids that hold. nodes (id, least): derived nodes and how many parents they need; parents (id, parent_id).

    leaves (id) hold by themselves. A derived node holds once all its parents hold and they are at least `least`; so
    cycles never do. Least fix-point, a round per level.
    """
    parents = written(parents.select("id", "parent_id").distinct())
    needs = written(parents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(nodes, "id").where("n >= least").select("id", "n"))
    held = written(leaves.select("id").distinct())
    count = held.count()
    while True:
        ready = parents.join(held.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("have"))
        held = written(held.union(needs.join(ready, "id").where("have = n").select("id")).distinct())
        after = held.count()
        if after == count:
            return held
        count = after


def verified(proposals: DataFrame, verdicts: DataFrame, least: float = ACCEPT_AT) -> DataFrame:
    """Proposals with verdict, confidence and accepted; a missing verdict rejects."""
    joined = proposals.join(verdicts, "proposal_id", "left")
    verdict = F.coalesce("verdict", F.lit("reject"))
    return joined.withColumn("verdict", verdict).withColumn("accepted", (verdict == "accept") & F.coalesce(F.col("confidence") >= least, F.lit(False)))


class Topological:
    """A topological order that is kept while edges come one by one; an edge that would close a cycle is refused.

    Only an edge against the order is searched for, and only between the places of its two ends, which then change places
    with what lies between them (Pearce and Kelly's way). New nodes go to the end or, if they lead to known ones, to the front.
    """

    def __init__(self):
        self.place: dict[object, int] = {}
        self.down: dict[object, list] = {}
        self.up: dict[object, list] = {}
        self.first, self.last = 0, 0

    def _new(self, node, front: bool) -> None:
        if front:
            self.first -= 1
        else:
            self.last += 1
        self.place[node] = self.first if front else self.last
        self.down[node], self.up[node] = [], []

    def _reached(self, start, near: dict[object, list], low: int, high: int) -> list:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen and low <= self.place[x] <= high:
                    seen.add(x)
                    todo.append(x)
        return list(seen)

    def add(self, source, target) -> bool:
        if source == target:
            return False
        if source not in self.place:
            self._new(source, target in self.place)
        if target not in self.place:
            self._new(target, False)
        high, low = self.place[source], self.place[target]
        if high > low:
            after = self._reached(target, self.down, low, high)
            if source in after:
                return False
            moved = [sorted(part, key=self.place.__getitem__) for part in (self._reached(source, self.up, low, high), after)]
            for node, at in zip(moved[0] + moved[1], sorted(self.place[x] for part in moved for x in part), strict=True):
                self.place[node] = at
        self.down[source].append(target)
        self.up[target].append(source)
        return True


def admit_acyclic(relations: DataFrame, split: bool = False) -> DataFrame:
    """Relations (graph_id, proposal_id, source_id, target_id, explicit, confidence) with column admitted.

    Within each graph they are admitted one by one (explicit first, then by confidence, then by id; nulls last) unless they
    would close a cycle. The order is the meaning: Spark sorts each graph's relations into it, and a task goes through its
    graphs one after another with an order of the nodes that is kept as edges come, of one graph at a time. Graphs are the
    unit of parallelism; split: weakly connected parts of graphs are, which decide nothing about each other, for graphs too
    large for a task.
    """
    out = ["graph_id", "proposal_id", "source_id", "target_id"]
    if not split:
        held, unit = relations, ["graph_id"]
    else:
        end = lambda c: F.struct("graph_id", F.col(c).alias("id"))
        parts = weak_parts(relations.select(end("source_id").alias("source_id"), end("target_id").alias("target_id")))
        held = relations.join(parts.select("id.graph_id", F.col("id.id").alias("source_id"), F.col("part.id").alias("part")), ["graph_id", "source_id"])
        unit = ["graph_id", "part"]
    sure = F.nanvl(F.col("confidence").cast("double"), F.lit(None).cast("double"))
    order = [*unit, F.desc_nulls_last("explicit"), sure.desc_nulls_last(), F.asc_nulls_last("proposal_id")]
    rows = held.repartition(*unit).sortWithinPartitions(*order).select(*out, F.struct(*unit).alias("unit"))

    def admit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = object(), Topological()
        for batch in batches:
            flags = []
            for graph, s, t in zip(*(batch.column(c).to_pylist() for c in ("unit", "source_id", "target_id")), strict=True):
                if graph != now:
                    now, seen = graph, Topological()
                flags.append(seen.add(s, t))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(flags, pa.bool_())], [*out, "admitted"])

    return rows.mapInArrow(admit, rows.select(*out, F.lit(True).alias("admitted")).schema)


def reasoning_steps(admitted: DataFrame) -> DataFrame:
    """PREMISE_OF and CONCLUDES edges of a step for each admitted relation (edge_type, source_id, target_id)."""
    from ..functions.text import stable_id

    step = stable_id("STEP", "edge_type", "source_id", "target_id")
    return admitted.select(F.explode(F.array(F.struct(F.col("source_id").alias("source_id"), F.lit("PREMISE_OF").alias("edge_type"), step.alias("target_id")), F.struct(step.alias("source_id"), F.lit("CONCLUDES").alias("edge_type"), F.col("target_id").alias("target_id")))).alias("e")).select("e.*")
