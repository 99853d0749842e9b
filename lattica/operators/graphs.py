"""Graphs and flows as tables of nodes and edges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ranked, sums_before
from ..functions.storage import written


def nodes_of(edges: DataFrame, source: str = "source", target: str = "target", order: str | None = None) -> DataFrame:
    """Distinct ends, numbered by first appearance where edges have an order."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(source).alias("id")), F.struct(F.lit(1).alias("side"), F.col(target).alias("id"))))
    rows = edges.select(*([order] if order else []), both.alias("e"))
    if not order:
        return rows.select("e.id").distinct()
    return rows.groupBy("e.id").agg(F.min(F.col(order).cast("long") * 2 + F.col("e.side")).alias("first"))


def degree(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """How often each node is an end of an edge."""
    return edges.select(F.explode(F.array(source, target)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def flow_totals(edges: DataFrame, value: str, source: str = "source", target: str = "target") -> DataFrame:
    """What flows into and out of each node, 0 where nothing does; one shuffle."""
    sides = F.explode(F.array(F.struct(F.col(target).alias("id"), F.col(value).alias("i"), F.lit(0.0).alias("o")), F.struct(F.col(source).alias("id"), F.lit(0.0).alias("i"), F.col(value).alias("o"))))
    return edges.select(sides.alias("s")).groupBy("s.id").agg(F.sum("s.i").alias("inflow"), F.sum("s.o").alias("outflow"))


def flow_levels(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Least number of edges from a root, a node that nothing flows into (with none: the least node); 0 for what no root reaches.
    Each round extends the frontier by one edge and keeps what is new."""
    pairs = written(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct())
    every = pairs.select(F.explode(F.array("s", "t")).alias("id")).distinct()
    roots = every.join(pairs.select(F.col("t").alias("id")), "id", "left_anti")
    if roots.isEmpty():
        roots = every.agg(F.min("id").alias("id"))
    known = frontier = written(roots.withColumn("level", F.lit(0)))
    for level in itertools.count(1):
        nxt = frontier.join(pairs, frontier.id == pairs.s).select(F.col("t").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
        frontier = written(nxt.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return every.join(known, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def connected(nodes: DataFrame, edges: DataFrame, source: str = "source", target: str = "target", node: str = "id") -> DataFrame:
    """id and component, the least id that undirected edges reach. Labels jump over labels, so rounds are few."""
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    pairs = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(nodes.select(F.col(node).alias("id"), F.col(node).alias("component")).distinct())
    while True:
        near = pairs.join(labels, pairs.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        got = labels.join(near, labels.id == near.a, "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("least"))
        got = written(got)
        jump = got.select(F.col("id").alias("least"), F.col("least").alias("further"))
        got = got.join(jump, "least", "left").select("id", F.coalesce(F.col("further"), F.col("least")).alias("new"), "component")
        got = written(got)
        if got.where("new <> component").isEmpty():
            return labels
        labels = got.select("id", F.col("new").alias("component"))


def component_summary(components: DataFrame) -> DataFrame:
    """How many components, and the size of the largest."""
    return components.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def ribbon_offsets(edges: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Where each edge starts on its node: the sum of the values before it. A node's edges are spread over tasks."""
    return sums_before(edges, [order], value, [by], "offset")


def stacked(nodes: DataFrame, level: str, total: str, ties: str, gap: float = 0.0) -> DataFrame:
    """Nodes of a level below each other, the largest first, with a gap between them: y."""
    return sums_before(nodes, [F.desc(total), ties], F.col(total) + F.lit(gap), [level], "y")


def indexed(nodes: DataFrame, order: str, node: str = "id") -> DataFrame:
    """Nodes with their index from 0."""
    return ranked(nodes, order, [node], rank="index").withColumn("index", F.col("index") - 1)


def by_index(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target", node: str = "id") -> DataFrame:
    """Edges with the indexes of both ends; loops and edges with an unknown end go."""
    a = nodes.select(F.col(node).alias(source), F.col("index").alias("source_index"))
    b = nodes.select(F.col(node).alias(target), F.col("index").alias("target_index"))
    return edges.join(a, source).join(b, target).where("source_index <> target_index")


def spring_forces(nodes: DataFrame, edges: DataFrame, charge: float = 1.0, spring: float = 0.05, gravity: float = 0.01, source: str = "source", target: str = "target", blocks: int = 8) -> DataFrame:
    """The force on every node of a laid-out network (id, x, y): charge / d^2 from every other node, spring * weight * d along
    edges, gravity * d to the middle. All pairs of nodes meet, block by block of ids, as the method has it: for some thousand nodes."""
    left = nodes.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("a")
    right = nodes.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).alias("b")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-6))
    push = left.join(right, "_c").where("a.id <> b.id").groupBy(F.col("a.id").alias("id")).agg(F.sum(charge * dx / (d2 * F.sqrt(d2))).alias("fx"), F.sum(charge * dy / (d2 * F.sqrt(d2))).alias("fy"))
    sides = lambda end, k: nodes.select(F.col("id").alias(end), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    ends = edges.join(sides(source, "s"), source).join(sides(target, "t"), target)
    gx, gy = spring * F.col("weight") * (F.col("tx") - F.col("sx")), spring * F.col("weight") * (F.col("ty") - F.col("sy"))
    pull = ends.select(F.explode(F.array(F.struct(F.col(source).alias("id"), gx.alias("fx"), gy.alias("fy")), F.struct(F.col(target).alias("id"), (-gx).alias("fx"), (-gy).alias("fy")))).alias("p")).select("p.*")
    home = nodes.select("id", (-gravity * F.col("x")).alias("fx"), (-gravity * F.col("y")).alias("fy"))
    return push.unionByName(pull).unionByName(home).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
