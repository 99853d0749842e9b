"""What statistical charts are drawn from."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, probit, real
from ..functions.ranking import ranked, with_scalars
from ..functions.selection import selected


def value_lists(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The values of each group as a list in the order of a column, and the group's place by first appearance. A list is one row,
    so this is for groups that a row can hold; the statistics above and below don't need it."""
    rows = df.select(group, F.struct(order, real(F.col(value)).alias("v")).alias("_p")).where(~F.isnan("_p.v"))
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list("_p")).alias("_l"))
    placed = ranked(lists.withColumn("_first", F.col("_l")[0][order]), "_first", [group], rank="place")
    return placed.select(group, (F.col("place") - 1).alias("place"), F.transform("_l", lambda p: p["v"]).alias("values"))


def midpoint_places(names: dict[str, float]) -> dict[str, Column]:
    """Both neighbours of the place (n - 1) p."""
    out = {}
    for name, p in names.items():
        at = (F.col("n") - 1) * F.lit(p)
        out |= {f"{name}_lo": F.floor(at), f"{name}_hi": F.ceil(at)}
    return out


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, q1, median, q3 (each the mean of the two values around its place), the whiskers, which are the furthest values within
    1.5 interquartile ranges of the box, and how many values lie outside."""
    q = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    boxes = selected(df, group, value, midpoint_places(q))
    boxes = boxes.select(group, "n", *(((F.col(f"{k}_lo") + F.col(f"{k}_hi")) / 2).alias(k) for k in q))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    rows = df.select(group, real(F.col(value)).alias("_v")).where(~F.isnan("_v")).join(boxes, group)
    inside = (F.col("_v") >= F.col("q1") - fence) & (F.col("_v") <= F.col("q3") + fence)
    ends = rows.groupBy(group).agg(F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.count_if(~inside).alias("outliers"))
    return boxes.join(ends, group)


def box_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """The rows outside the fences of their group's box."""
    boxes = box_stats(df, group, value).select(group, "q1", "q3")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    v = real(F.col(value))
    return df.join(boxes, group).where((v < F.col("q1") - fence) | (v > F.col("q3") + fence)).drop("q1", "q3")


def violin_box(df: DataFrame, group: str, value: str) -> DataFrame:
    """n and the values at the places floor(n p): the lower quantiles that violins show."""
    places = {name: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))) for name, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items()}
    return selected(df, group, value, places)


def kernel_density(df: DataFrame, group: str, value: str, points: int = 65, bandwidth: float = 1.0, pad: float = 0.05) -> DataFrame:
    """Gaussian density of each group at `points` places over all groups' padded range. The bandwidth is bandwidth * population
    deviation (1 if that is 0) * 1.06 * n^(-1/5). A task adds its rows up to one row of sums for each of its groups; only these
    become rows, one for each place, and meet."""
    v = df.select(group, real(F.col(value)).alias("_v")).where(~F.isnan("_v"))
    groups = v.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop("_v").alias("_std"))
    h = F.lit(bandwidth) * F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std")) * 1.06 * F.pow("n", F.lit(-0.2))
    groups = with_limits(groups.withColumn("h", h).drop("_std"), v)
    span = F.col("_high") - F.col("_low")
    margin = F.when(span == 0, F.lit(1.0)).otherwise(span) * pad
    groups = groups.select(group, "n", "h", (F.col("_low") - margin).alias("_from"), (span + 2 * margin).alias("_span"))
    at = np.arange(points) / (points - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            kind = batch.column(0).dictionary_encode()
            codes = kind.indices.fill_null(len(kind.dictionary)).to_numpy(zero_copy_only=False)
            v, h, start, width = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            for code in np.unique(codes):
                own = np.flatnonzero(codes == code)
                name = kind.dictionary[int(code)] if code < len(kind.dictionary) else None
                places = start[own[0]] + width[own[0]] * at
                total = sums.setdefault(name, np.zeros(points))
                for k in range(0, len(own), 4096):
                    total += np.exp(-0.5 * ((places - v[own[k : k + 4096], None]) / h[own[0]]) ** 2).sum(0)
        if sums:
            names = pa.array([None if x is None else x.as_py() for x in sums], kind.dictionary.type)
            yield pa.RecordBatch.from_arrays([names, pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["g", "sums"])

    named = groups.withColumnRenamed(group, "_g")
    rows = v.join(named, F.col(group) == F.col("_g")).select("_g", "_v", "h", "_from", "_span")
    kind = dict(groups.dtypes)[group]
    parts = rows.mapInArrow(run, f"_g {kind}, sums array<double>").select("_g", F.posexplode("sums").alias("point", "_sum"))
    sums = parts.groupBy("_g", "point").agg(F.sum("_sum").alias("_sum")).join(named, "_g")
    place = F.col("_from") + F.col("_span") * F.col("point") / (points - 1)
    return sums.select(F.col("_g").alias(group), F.col("point").cast("long").alias("point"), place.alias("x"), (F.col("_sum") / (F.col("n") * F.col("h"))).alias("density"))


def with_limits(groups: DataFrame, values: DataFrame) -> DataFrame:
    """Every group with the least and greatest value of all."""
    return groups.crossJoin(F.broadcast(values.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))))


def qq_points(df: DataFrame, value: str, ties: list | None = None, step: int = 1) -> DataFrame:
    """Sample against normal quantiles: rn, theoretical = probit((i + 1/2) / n), and the value less the mean over the sample
    deviation (1 if that is 0). Every step-th value in order is taken."""
    rows = ranked(df.where(~F.isnan(real(F.col(value)))), value, ties)
    if step > 1:
        rows = rows.where((F.col("rn") - 1) % step == 0).withColumn("rn", F.floor((F.col("rn") - 1) / step) + 1)
    v = real(F.col(value))
    rows = with_scalars(rows, F.count("*").alias("_n"), F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"))
    std = F.when(F.coalesce(F.col("_std"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_std"))
    return rows.select("rn", probit((F.col("rn") - 0.5) / F.col("_n")).alias("theoretical"), ((v - F.col("_mean")) / std).alias("sample"))


def qq_line(points: DataFrame) -> DataFrame:
    """Slope and intercept of the line through the quartiles of both sides, each the mean of the two values around its place."""
    rows = points.withColumn("_all", F.lit(0))
    places = midpoint_places({"q1": 0.25, "q3": 0.75})
    t = selected(rows, "_all", "theoretical", places).select("_all", *((F.col(f"{k}_lo") / 2 + F.col(f"{k}_hi") / 2).alias(f"t_{k}") for k in ("q1", "q3")))
    s = selected(rows, "_all", "sample", places).select("_all", *((F.col(f"{k}_lo") / 2 + F.col(f"{k}_hi") / 2).alias(f"s_{k}") for k in ("q1", "q3")))
    slope = (F.col("s_q3") - F.col("s_q1")) / F.when(F.col("t_q3") == F.col("t_q1"), F.lit(1.0)).otherwise(F.col("t_q3") - F.col("t_q1"))
    return t.join(s, "_all").select(slope.alias("slope"), (F.col("s_q1") - slope * F.col("t_q1")).alias("intercept"))


def bar_totals(df: DataFrame, label: str, value: str) -> DataFrame:
    """A bar for each label, largest first: total, its slot, and the axis, which has 0 on it."""
    totals = df.groupBy(label).agg(F.sum(real(F.col(value))).alias("total"))
    slots = ranked(totals, "total", [label], rank="slot", descending=True)
    axis = with_scalars(slots.withColumn("slot", F.col("slot") - 1), F.least(F.lit(0.0), F.min("total")).alias("axis_min"), F.greatest(F.lit(0.0), F.max("total")).alias("axis_max"))
    return axis


def error_band(df: DataFrame, x: str, y: str, error: str) -> DataFrame:
    """x, y and y -+ |error|."""
    e = F.abs(real(F.col(error)))
    return df.select(x, y, (real(F.col(y)) - e).alias("lo"), (real(F.col(y)) + e).alias("hi"))


def radar_vertices(df: DataFrame, series: str, axes: list[str]) -> DataFrame:
    """A corner for each series and axis: axis k of n at the angle 2 pi k / n - pi / 2, at the value over the series' greatest
    absolute value (at least 1)."""
    top = F.greatest(F.lit(1.0), *(F.abs(real(F.col(a))) for a in axes))
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), (real(F.col(a)) / top).alias("radius"), F.lit(2 * math.pi * k / len(axes) - math.pi / 2).alias("angle")) for k, a in enumerate(axes))))
    rows = df.select(series, corner.alias("c")).select(series, "c.*")
    return rows.withColumns({"x": F.col("radius") * F.cos("angle"), "y": F.col("radius") * F.sin("angle")})


def bubble_radius(df: DataFrame, size: str, largest: float = 24.0) -> DataFrame:
    """radius: 3 for the least size to `largest` for the greatest; sizes below 0 count as 0."""
    s = F.greatest(F.lit(0.0), real(F.col(size)))
    rows = with_scalars(df, F.min(s).alias("_a"), F.max(s).alias("_b"))
    span = F.when(F.col("_b") == F.col("_a"), F.lit(1.0)).otherwise(F.col("_b") - F.col("_a"))
    return rows.withColumn("radius", 3 + (s - F.col("_a")) / span * (largest - 3)).drop("_a", "_b")


def ramp_place(df: DataFrame, value: str, out: str = "t") -> DataFrame:
    """Where a value lies between the bounds, from 0 to 1."""
    v = real(F.col(value))
    rows = with_scalars(df, F.min(v).alias("_a"), F.max(v).alias("_b"))
    return rows.withColumn(out, clamp((v - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9)), 0.0, 1.0)).drop("_a", "_b")


def moving_average(df: DataFrame, order: str, value: str, width: int, within: list[str] | None = None, out: str = "smooth") -> DataFrame:
    """Centred mean over half = width // 2 rows to each side, fewer at the ends, of all rows or `within` groups.

    Rows are ranked and dealt in blocks of consecutive places, long enough that the rows near a block's edges, which the block next
    to it gets as well, are under a twentieth. In a block, sums up to each row give every mean from two of them, whatever the
    width. Nulls don't count; what isn't finite is counted apart, so that it spoils only the means it belongs to.
    """
    half = max(0, width // 2)
    block = max(4096, 40 * half)
    within = list(within or [])
    placed = ranked(df, order, within=within, rank="_place")
    own = F.floor((F.col("_place") - 1) / block)
    inside = F.pmod(F.col("_place") - 1, F.lit(block))
    copies = F.array_compact(F.array(own, F.when((inside < half) & (own > 0), own - 1), F.when(inside >= block - half, own + 1)))
    v = real(F.col(value))
    finite = F.abs(v) < float("inf")
    parts = {"_sum": F.when(finite, v).otherwise(0.0), "_n": v.isNotNull().cast("long"), "_nan": F.coalesce(F.isnan(v), F.lit(False)).cast("long"), "_up": F.coalesce(v == float("inf"), F.lit(False)).cast("long"), "_down": F.coalesce(v == -float("inf"), F.lit(False)).cast("long")}
    rows = placed.withColumn("_block", F.explode(copies)).withColumn("_own", F.col("_block") == own)
    order_ = Window.partitionBy(*within, "_block").orderBy("_place")
    last = Window.partitionBy(*within, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({n: F.sum(e).over(order_.rowsBetween(Window.unboundedPreceding, 0)) for n, e in parts.items()})
    total = {n: F.coalesce(F.lead(n, half).over(order_), F.last(n).over(last)) - F.coalesce(F.lag(n, half + 1).over(order_), F.lit(0)) for n in parts}
    rows = rows.withColumns({f"{n}_in": e for n, e in total.items()}).where("_own")
    strange = F.when((F.col("_nan_in") > 0) | ((F.col("_up_in") > 0) & (F.col("_down_in") > 0)), float("nan")).when(F.col("_up_in") > 0, float("inf")).when(F.col("_down_in") > 0, -float("inf"))
    mean = F.when(F.col("_n_in") > 0, F.coalesce(strange, F.col("_sum_in") / F.col("_n_in")))
    return rows.withColumn(out, mean).drop("_place", "_block", "_own", *parts, *(f"{n}_in" for n in parts))


def prefix_mean(df: DataFrame, order: str, value: str, lengths: list[int]) -> DataFrame:
    """k and the mean of the first k rows, for each k: how an estimate converges."""
    placed = ranked(df, order, rank="_place")
    wanted = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda k: k >= F.col("_place")))
    return placed.select(wanted.alias("k"), real(F.col(value)).alias("_v")).groupBy("k").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))


def axis_ticks(df: DataFrame, value: str, ticks: int = 5, pad: float = 0.08) -> DataFrame:
    """Evenly spaced ticks over the padded range."""
    v = real(F.col(value))
    limits = df.agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    span = F.when(F.col("_b") == F.col("_a"), F.lit(1.0)).otherwise(F.col("_b") - F.col("_a"))
    low, width = F.col("_a") - span * pad, span * (1 + 2 * pad)
    return df.sparkSession.range(ticks).crossJoin(F.broadcast(limits)).select(F.col("id").alias("tick"), (low + width * F.col("id") / (ticks - 1)).alias("at"))
