"""Bodies in blocks, particles and formula-driven points, as joins, sums and row-local folds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import lcg, mulberry32, real


BLOCK = 4096  # bodies in a block, or so
TILE = 4  # bodies of a block that meet another block at once: matrices that caches hold


def blocks_of(bodies: DataFrame, count: int, *columns: Column) -> DataFrame:
    """block, and p: a block's bodies as a list of id, the columns. Equal ids share a block."""
    block = F.pmod(F.xxhash64("id"), F.lit(count))
    return bodies.select(block.alias("block"), F.struct("id", *columns).alias("p")).groupBy("block").agg(F.collect_list("p").alias("p"))


def met(left: DataFrame, right: DataFrame, count: int, upper: bool, run: Callable, schema: str) -> DataFrame:
    """run(left p, right p, same) for each pair of blocks (`upper`: for one of both orders), as rows of the schema. Every pair is dealt
    out by its own key, so that a task holds two blocks at a time."""
    every = F.sequence(F.lit(0), F.lit(count - 1))
    a = left.select(F.col("block").alias("a"), F.explode(F.filter(every, lambda k: k >= F.col("block")) if upper else every).alias("b"), F.col("p").alias("p"))
    b = right.select(F.explode(F.filter(every, lambda k: k <= F.col("block")) if upper else every).alias("a"), F.col("block").alias("b"), F.col("p").alias("q"))
    parts = max(1, min(count * count, 1024))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column("same").to_pylist()
            for k in range(batch.num_rows):
                yield run(batch.column("p")[k].values, batch.column("q")[k].values, same[k])

    deal = lambda df: df.withColumn("part", F.pmod(F.col("a") * count + F.col("b"), F.lit(parts)))
    pairs = deal(a).repartition(parts, "part").join(deal(b).repartition(parts, "part"), ["part", "a", "b"])
    return pairs.select((F.col("a") == F.col("b")).alias("same"), "p", "q").mapInArrow(whole, schema)


def values(p: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [p.field(n).to_numpy(zero_copy_only=False) for n in names]


def tiles(p: pa.StructArray, q: pa.StructArray, same: bool, soft: float) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
    """A few bodies of p against all of q: which, the differences along the axes, and the squares of the softened distances; these are
    infinite between bodies of one id."""
    a, b = values(p, *"xyz"), values(q, *"xyz")
    if same:
        code = pc.index_in(p.field("id"), pc.unique(p.field("id"))).to_numpy()
        other = pc.index_in(q.field("id"), pc.unique(p.field("id"))).fill_null(-1).to_numpy()
    for start in range(0, len(p), TILE):
        own = slice(start, start + TILE)
        d = [v - u[own, None] for u, v in zip(a, b)]
        r2 = d[0] * d[0]
        for x in d[1:]:
            r2 += x * x
        r2 += soft * soft
        if same:
            r2[code[own, None] == other] = math.inf
        yield own, d, r2


def bodies_step(bodies: DataFrame, dt: float = 0.001, g: float = 0.05, soft: float = 0.03, physical: bool = False, block: int = BLOCK) -> DataFrame:
    """One semi-implicit Euler step of all bodies (id, x, y, z, vx, vy, vz, m). By default the force, with both masses in it, acts
    as the acceleration; `physical` leaves the body's own mass out. Blocks of about `block` bodies meet in pairs, each pair in a task
    of its own, as matrices: a cost of n^2, as the method has it, and the memory of two blocks. Bodies that lack a number neither pull
    nor are pulled."""
    count = max(1, math.ceil(bodies.count() / block))
    axes = [F.col(k).cast("double").alias(k) for k in "xyz"]
    pulled = bodies.dropna(subset=["id", *"xyz", *([] if physical else ["m"])])
    pulling = bodies.dropna(subset=["id", *"xyz", "m"])
    own_mass = (F.lit(1.0) if physical else F.col("m").cast("double")).alias("m")

    def run(p: pa.StructArray, q: pa.StructArray, same: bool) -> pa.RecordBatch:
        forces = np.empty((3, len(p)))
        (own_m,), (m,) = values(p, "m"), values(q, "m")
        with np.errstate(divide="raise", invalid="ignore", over="ignore"):
            for own, d, r2 in tiles(p, q, same, soft):
                pull = np.sqrt(r2)
                pull *= r2
                np.divide(g * m, pull, out=pull)
                for k in range(3):
                    forces[k, own] = np.einsum("ij,ij->i", pull, d[k]) * own_m[own]
        return pa.RecordBatch.from_arrays([p.field("id"), *map(pa.array, forces)], ["id", "fx", "fy", "fz"])

    kind = bodies.schema["id"].dataType.simpleString()
    met_ = met(blocks_of(pulled, count, *axes, own_mass), blocks_of(pulling, count, *axes, F.col("m").cast("double").alias("m")), count, False, run, f"id {kind}, fx double, fy double, fz double")
    forces = met_.groupBy("id").agg(*(F.sum(f"f{k}").alias(f"f{k}") for k in "xyz"))
    moved = bodies.join(forces, "id", "left").fillna(0.0, ["fx", "fy", "fz"])
    speeds = {f"v{k}": F.col(f"v{k}") + F.col(f"f{k}") * dt for k in "xyz"}
    return moved.withColumns(speeds).withColumns({k: F.col(k) + F.col(f"v{k}") * dt for k in "xyz"}).select(*bodies.columns)


def total_energy(bodies: DataFrame, g: float = 0.05, soft: float = 0.03, block: int = BLOCK) -> DataFrame:
    """Kinetic energy less the sum of G m m / sqrt(d^2 + soft^2) over pairs: kinetic, potential, energy. Blocks of about `block` bodies
    meet in pairs, as in bodies_step, and every two once."""
    count = max(1, math.ceil(bodies.count() / block))
    own = blocks_of(bodies.dropna(subset=["id", *"xyz", "m"]), count, *(F.col(k).cast("double").alias(k) for k in (*"xyz", "m")))

    def run(p: pa.StructArray, q: pa.StructArray, same: bool) -> pa.RecordBatch:
        (own_m,), (m,) = values(p, "m"), values(q, "m")
        total = 0.0
        with np.errstate(divide="raise", invalid="ignore", over="ignore"):
            for some, _, r2 in tiles(p, q, same, soft):
                total += float(own_m[some] @ (np.divide(1.0, np.sqrt(r2, out=r2), out=r2) @ m))
        return pa.RecordBatch.from_arrays([pa.array([g * total / (2 if same else 1)])], ["part"])

    potential = met(own, own, count, True, run, "part double").agg(F.coalesce(-F.sum("part"), F.lit(0.0)).alias("potential"))
    kinetic = bodies.agg(F.sum(0.5 * F.col("m") * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).alias("kinetic"))
    return kinetic.crossJoin(potential).withColumn("energy", F.col("kinetic") + F.col("potential"))


def particles(df: DataFrame, steps: int = 240, dt: float = 0.01, speed: float = 1.0) -> DataFrame:
    """Particles (x, y, vx, vy) that move and are reflected at -1 and 1; all steps of a row in one fold, without a shuffle."""

    def axis(p: Column, v: Column) -> tuple[Column, Column]:
        at = p + v * (dt * speed)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at)), F.when((at > 1) | (at < -1), -v).otherwise(v)

    def step(s: Column, _: Column) -> Column:
        x, vx = axis(s["x"], s["vx"])
        y, vy = axis(s["y"], s["vy"])
        return F.struct(x.alias("x"), y.alias("y"), vx.alias("vx"), vy.alias("vy"))

    start = F.struct(*(real(F.col(c)).alias(c) for c in ("x", "y", "vx", "vy")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step) if steps else start
    rest = [c for c in df.columns if c not in ("x", "y", "vx", "vy")]
    return df.select(*rest, end.alias("_s")).select(*rest, "_s.*")


def escape_counts(spark: SparkSession, width: int, height: int, most: int = 100, center: tuple = (-0.5, 0.0), span: float = 3.0, julia: tuple | None = None) -> DataFrame:
    """row, col and n, how many iterations z <- z^2 + c stays within 2, for each pixel of a view of the Mandelbrot set, or of the
    Julia set of a constant."""
    px = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    cx = F.lit(center[0]) + ((F.col("col") + 0.5) / width - 0.5) * span
    cy = F.lit(center[1]) + ((F.col("row") + 0.5) / height - 0.5) * span * height / width
    px = px.withColumns({"cx": cx, "cy": cy})
    ax, ay = (F.lit(float(julia[0])), F.lit(float(julia[1]))) if julia else (F.col("cx"), F.col("cy"))

    def step(s: Column, _: Column) -> Column:
        inside = s["x"] * s["x"] + s["y"] * s["y"] <= 4
        x = F.when(inside, s["x"] * s["x"] - s["y"] * s["y"] + ax).otherwise(s["x"])
        y = F.when(inside, 2 * s["x"] * s["y"] + ay).otherwise(s["y"])
        return F.struct(x.alias("x"), y.alias("y"), (s["n"] + F.when(inside, 1).otherwise(0)).alias("n"))

    z0 = (F.col("cx"), F.col("cy")) if julia else (F.lit(0.0), F.lit(0.0))
    start = F.struct(z0[0].alias("x"), z0[1].alias("y"), F.lit(0).alias("n"))
    return px.select("row", "col", F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["n"].alias("n"))


# fixed values: the fern's four maps (a, b, c, d, e, f) and how often each is taken
FERN = [(0.0, 0.0, 0.0, 0.16, 0.0, 0.0, 0.01), (0.85, 0.04, -0.04, 0.85, 0.0, 1.6, 0.85), (0.2, -0.26, 0.23, 0.22, 0.0, 1.6, 0.07), (-0.15, 0.28, 0.26, 0.24, 0.0, 0.44, 0.07)]


def fern(spark: SparkSession, points: int, seed: int = 1, steps: int = 30) -> DataFrame:
    """Points of the fern's attractor: each point folds its own stretch of random maps, so points need no order."""

    def step(s: Column, k: Column) -> Column:
        u = mulberry32(F.col("id") * steps + k, seed)
        x, y, low = s["x"], s["y"], 0.0
        nx, ny = None, None
        for a, b, c, d, e, f, p in FERN:
            low += p
            px, py = a * x + b * y + e, c * x + d * y + f
            nx = F.when(u < low, px) if nx is None else nx.when(u < low, px)
            ny = F.when(u < low, py) if ny is None else ny.when(u < low, py)
        a, b, c, d, e, f, _ = FERN[-1]
        return F.struct(nx.otherwise(a * x + b * y + e).alias("x"), ny.otherwise(c * x + d * y + f).alias("y"))

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return spark.range(points).select("id", F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, step).alias("p")).select("id", "p.x", "p.y")


def koch(spark: SparkSession, depth: int) -> DataFrame:
    """Segments (x1, y1, x2, y2) of the Koch snowflake: every round turns each into four."""
    corners = [(math.cos(a), math.sin(a)) for a in (math.pi / 2, -math.pi / 6, -5 * math.pi / 6)]
    rows = [(k, *corners[k], *corners[(k + 1) % 3]) for k in range(3)]
    segments = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    for _ in range(depth):
        dx, dy = (F.col("x2") - F.col("x1")) / 3, (F.col("y2") - F.col("y1")) / 3
        ax, ay, bx, by = F.col("x1") + dx, F.col("y1") + dy, F.col("x2") - dx, F.col("y2") - dy
        half, root = 0.5, math.sqrt(3) / 2
        tx, ty = ax + dx * half - dy * root, ay + dx * root + dy * half
        points = [(F.col("x1"), F.col("y1")), (ax, ay), (tx, ty), (bx, by), (F.col("x2"), F.col("y2"))]
        parts = [F.struct((F.col("id") * 4 + k).alias("id"), p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for k, (p, q) in enumerate(zip(points, points[1:]))]
        segments = segments.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return segments


def lissajous(spark: SparkSession, a: float = 3, b: float = 2, phase: float = math.pi / 2, points: int = 2001) -> DataFrame:
    t = F.col("id") / (points - 1) * (2 * math.pi)
    return spark.range(points).select("id", F.sin(a * t + phase).alias("x"), F.sin(b * t).alias("y"))


def harmonograph(spark: SparkSession, f: tuple = (2.0, 3.0), phase: tuple = (0.0, math.pi / 2), decay: float = 0.02, length: float = 60.0, points: int = 12_001) -> DataFrame:
    t = F.col("id") / (points - 1) * length
    fade = F.exp(-decay * t)
    return spark.range(points).select("id", (F.sin(f[0] * t + phase[0]) * fade).alias("x"), (F.sin(f[1] * t + phase[1]) * fade).alias("y"))


def spirograph(spark: SparkSession, outer: int = 96, inner: int = 35, pen: float = 20.0, points: int = 2000) -> DataFrame:
    turns = inner // math.gcd(outer, inner)
    t = F.col("id") / (points - 1) * (2 * math.pi * turns)
    k = (outer - inner) / inner
    return spark.range(points).select("id", ((outer - inner) * F.cos(t) + pen * F.cos(k * t)).alias("x"), ((outer - inner) * F.sin(t) - pen * F.sin(k * t)).alias("y"))


def truchet(spark: SparkSession, width: int, height: int, seed: int = 1) -> DataFrame:
    """row, col and one of four tiles."""
    return spark.range(width * height).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"), F.floor(mulberry32(F.col("id"), seed) * 4).alias("tile"))


def random_walk_free(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """Independent numbers of the linear congruential stream."""
    return spark.range(count).select("id", lcg(F.col("id"), seed).alias("x"))
