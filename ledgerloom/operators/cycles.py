"""Cycles and connected parts of directed graphs, in rounds that follow the logarithm of a chain's length, not the length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import drop_written, written


def _taken(edges: DataFrame) -> DataFrame:
    """Nodes (id) that one round takes out, no two of them adjacent: of those with one parent or one child at most, the ones
    whose hash is the smallest among their neighbours of that sort."""
    ends = edges.select("a", F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
    degrees = ends.groupBy(F.col("a").alias("id")).agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    fit = degrees.where("`in` <= 1 or out <= 1").select("id", F.xxhash64("id").alias("h"))
    near = edges.join(fit.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(fit.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    beaten = near.select(F.when(F.struct("ha", "a") < F.struct("hb", "b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    return fit.join(beaten, "id", "left_anti").select("id")


def _passed(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without the nodes `gone`, their parents linked to their children, and (id, a, b) of those links."""
    heads, tails = gone.select(F.col("id").alias("b")), gone.select(F.col("id").alias("a"))
    into, outof = edges.join(heads, "b", "left_semi").select("a", F.col("b").alias("id")), edges.join(tails, "a", "left_semi").select(F.col("a").alias("id"), "b")
    links = into.join(outof, "id").select("id", "a", "b")
    kept = edges.join(heads, "b", "left_anti").join(tails, "a", "left_anti").select("a", "b")
    return kept.union(links.select("a", "b").where("a <> b")).distinct(), links


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, component) of some strongly connected components of a core, at least one if it has any node.

    Every node takes the largest id that reaches it; those of a colour that reach its own node again are a component.
    """
    colour = written(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("c", F.col("id")), "colour")
    while True:
        best = edges.join(colour.select(F.col("id").alias("a"), "c"), "a").groupBy(F.col("b").alias("id")).agg(F.max("c").alias("n"))
        after = written(colour.join(best, "id", "left").select("id", F.greatest("c", "n").alias("c"), (F.col("n") > F.col("c")).alias("moved")), "colour")
        moved = not after.where("moved").isEmpty()
        drop_written(colour)
        colour = after.select("id", "c")
        if not moved:
            break
    inside = edges.join(colour.select(F.col("id").alias("a"), "c"), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").where("c = d").select("a", "b", "c")
    inside = written(inside, "inside")
    found, new = [], colour.where("id = c").select("id", "c")
    while not new.isEmpty():
        found.append(written(new, "found"))
        back = inside.join(found[-1].select(F.col("id").alias("b")), "b").select(F.col("a").alias("id"), "c").distinct()
        new = written(back.join(reduce(DataFrame.union, found), ["id", "c"], "left_anti"), "new")
    return reduce(DataFrame.union, found).select("id", F.col("c").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node on a cycle, component being the smallest id of its strongly connected component.

    edges: source_id, target_id. Empty iff the graph has no cycle; a node that only leads to one is no part of it; a loop is
    a component by itself; edges with a null end count as absent. Nodes with one parent or one child at most are taken out
    round by round, a third of a chain at a time, and their parents linked to their children, which never adds edges; what
    is left has several of both everywhere, and is coloured. On the way back a node joins a component if a parent and a
    child of it are in that one.
    """
    good = edges.where("source_id is not null and target_id is not null")
    loops = good.where("source_id = target_id").select(F.col("source_id").alias("id"))
    current, levels = written(good.where("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "edges"), []
    core, settled = [], None
    while not current.isEmpty():
        gone = written(_taken(current), "gone")
        if not gone.isEmpty():
            after, links = _passed(current, gone)
            links = written(links, "links")
            levels.append((links, not links.where("a = b").isEmpty()))
            current = written(after, "edges")
            continue
        part = written(_coloured(current), "core")
        core.append(part)
        levels.append((None, len(core) - 1))
        ids = part.select("id")
        current = written(current.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").join(ids.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "edges")
    for links, mark in reversed(levels):
        if links is None:
            grown = core[mark]
            settled = grown if settled is None else written(settled.union(grown), "settled")
        elif mark or settled is not None:
            settled = written(_joined(links, settled), "settled")
    if settled is None:
        settled = loops.select("id", F.col("id").alias("component")).limit(0)
    big = settled.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = settled.join(big, "component").select("id", F.col("least").alias("component"))
    single = loops.distinct().join(named, "id", "left_anti").select("id", F.col("id").alias("component"))
    return named.union(single)


def _joined(links: DataFrame, settled: DataFrame | None) -> DataFrame:
    """settled with the nodes of links (id, a, b) whose a and b are one component or one node; the latter joins it then."""
    same = links.where("a = b").select("id", F.col("a").alias("other"))
    if settled is None:
        whole = same.select("id", F.col("other").alias("component"))
        return whole.union(same.select("other", "other")).distinct()
    mine, theirs = settled.select(F.col("id").alias("a"), F.col("component").alias("x")), settled.select(F.col("id").alias("b"), F.col("component").alias("y"))
    inside = links.where("a <> b").join(mine, "a").join(theirs, "b").where("x = y").select("id", F.col("x").alias("component"))
    known = same.join(settled.select(F.col("id").alias("other"), F.col("component").alias("c")), "other", "left")
    pairs = known.select("id", F.coalesce("c", "other").alias("component")).union(known.where("c is null").select("other", "other"))
    return settled.union(inside).union(pairs).distinct()


def weak_parts(edges: DataFrame) -> DataFrame:
    """(id, part) of every end of edges (source_id, target_id): part is the smallest id that it is connected with, directions aside.

    Every node takes the smallest label near it, then the label of its label, until none moves: rounds follow the logarithm
    of the longest way for all but contrived graphs. Edges with a null end count as absent.
    """
    good = edges.where("source_id is not null and target_id is not null")
    both = written(good.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(good.select("target_id", "source_id")).distinct(), "both")
    label = written(both.select(F.col("a").alias("id"), "b").groupBy("id").agg(F.least("id", F.min("b")).alias("part")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        nearer = written(label.join(near, "id").select("id", F.col("part").alias("before"), F.least("part", "near").alias("part")), "near")
        jump = nearer.select(F.col("id").alias("part"), F.col("part").alias("next"))
        after = written(nearer.join(jump, "part").select("id", "before", F.least("part", "next").alias("part")), "label")
        moved = not after.where("part <> before").isEmpty()
        drop_written(label)
        drop_written(nearer)
        label = after.select("id", "part")
        if not moved:
            return label
