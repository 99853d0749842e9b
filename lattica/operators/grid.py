"""Grids (row, col, value) and points: colours, projections, contours, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import NAN, clamp, piecewise, real
from ..functions.ranking import with_scalars

SIDE = 64  # of a tile, in cells

# fixed values: stops of the colour ramps as place: (red, green, blue); heat in shares, the others in 255ths
HEAT = [(0.0, (0.13, 0.23, 0.74)), (0.25, (0.18, 0.64, 0.86)), (0.5, (0.17, 0.94, 0.67)), (0.75, (0.98, 0.86, 0.26)), (1.0, (0.93, 0.28, 0.13))]
VIRIDIS = [(0.0, (68, 1, 84)), (0.25, (59, 82, 139)), (0.5, (33, 145, 140)), (0.75, (94, 201, 98)), (1.0, (253, 231, 37))]
TEAL = [(0.0, (6, 10, 14)), (0.5, (45, 190, 173)), (0.5, (45, 212, 191)), (1.0, (255, 255, 255))]
GRAY = [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))]


def to_grid(df: DataFrame, matrix: str, padded: bool = False) -> DataFrame:
    """row, col, value from a column of arrays of arrays. A strict grid with rows of unequal length or missing or NaN values has
    no cells; a padded one is filled up with NaN."""
    width = F.aggregate(matrix, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    whole = F.forall(matrix, lambda r: (F.size(r) == F.size(F.element_at(F.col(matrix), 1))) & F.forall(r, lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = df.select(F.posexplode(matrix).alias("row", "_r"), width.alias("_w")) if padded else df.where(whole).select(F.posexplode(matrix).alias("row", "_r"), F.size(F.element_at(F.col(matrix), 1)).alias("_w"))
    cells = rows.where("_w > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("col"), "_r")
    return cells.select("row", "col", F.coalesce(F.get("_r", F.col("col")), F.lit(NAN)).alias("value"))


def grid_stats(cells: DataFrame) -> DataFrame:
    sound = F.when(~F.isnan("value"), F.col("value"))
    return cells.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.min(sound).alias("min"), F.max(sound).alias("max"))


def ramp(t: Column, stops: list[tuple[float, tuple]]) -> list[Column]:
    """The channels of a colour ramp at t."""
    return [piecewise(t, [(p, c[k]) for p, c in stops]) for k in range(len(stops[0][1]))]


def rounded_ramp(t: Column, name: str = "viridis") -> list[Column]:
    """Whole channels, 0 to 255, of a named ramp; thermal is a power of t in each channel."""
    t = clamp(t, 0.0, 1.0)
    if name == "thermal":
        return [F.floor(c + 0.5) for c in (255 * t, 120 * t * t, 40 * t * t * t)]
    stops = {"viridis": VIRIDIS, "teal": TEAL, "gray": GRAY}[name]
    return [F.floor(c + 0.5) for c in ramp(t, stops)]


def heat_colors(cells: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """red, green, blue of each cell between the bounds (by default the grid's); no span: the coldest."""
    rows = with_scalars(cells, F.min("value").alias("_a"), F.max("value").alias("_b"))
    a = F.lit(float(low)) if low is not None else F.col("_a")
    b = F.lit(float(high)) if high is not None else F.col("_b")
    t = F.when(b > a, clamp((F.col("value") - a) / F.when(b > a, b - a).otherwise(F.lit(1.0)), 0.0, 1.0)).otherwise(F.lit(0.0))
    red, green, blue = ramp(t, HEAT)
    return rows.withColumns({"red": red, "green": green, "blue": blue}).drop("_a", "_b")


def fit_view(df: DataFrame, x: str, y: str, width: float, height: float, pad: float = 0.12) -> DataFrame:
    """One row: scale, ox, oy that put all points into a view with a margin."""
    limits = df.agg(*(f(real(F.col(c))).alias(f"{c2}{n}") for c, c2 in ((x, "x"), (y, "y")) for n, f in (("0", F.min), ("1", F.max))))
    w = F.when(F.col("x1") == F.col("x0"), F.lit(1.0)).otherwise(F.col("x1") - F.col("x0"))
    h = F.when(F.col("y1") == F.col("y0"), F.lit(1.0)).otherwise(F.col("y1") - F.col("y0"))
    scale = F.least(width / (w * (1 + pad * 2)), height / (h * (1 + pad * 2)))
    rows = limits.withColumn("scale", scale)
    return rows.select("scale", (width / 2 - F.col("scale") * (F.col("x0") + F.col("x1")) / 2).alias("ox"), (height / 2 + F.col("scale") * (F.col("y0") + F.col("y1")) / 2).alias("oy"))


def project(df: DataFrame, x: str, y: str, width: float, height: float, scale: Column, ox: Column, oy: Column, size: float = 2.0) -> DataFrame:
    """sx, sy on the screen (y upwards) and vis, 1 for what lies in the view, else 0."""
    sx, sy = ox + real(F.col(x)) * scale, oy - real(F.col(y)) * scale
    rows = df.withColumns({"sx": sx, "sy": sy})
    seen = F.col("sx").between(0, width) & F.col("sy").between(0, height)
    return rows.withColumns({"size": F.lit(float(size)), "vis": F.when(seen, 1).otherwise(0)})


def project_fitted(df: DataFrame, x: str, y: str, width: float, height: float, size: float = 2.0) -> DataFrame:
    rows = df.crossJoin(F.broadcast(fit_view(df, x, y, width, height)))
    return project(rows, x, y, width, height, F.col("scale"), F.col("ox"), F.col("oy"), size).drop("scale", "ox", "oy")


def tiles(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """The grid in square tiles, as a table that kernels work on row by row: tile_row, tile_col, and values, an array of side + 1 rows
    of side + 1 values, of which the last row and column are those of the tiles below and to the right. Missing cells are null.
    A cell is shuffled once, or twice or four times if it is in its tile's first row, column or both: 1 + 2 / side times or so."""
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    up, left = F.floor(row / side), F.floor(col / side)
    in_tile = lambda dr, dc: F.struct((up - dr).alias("tile_row"), (left - dc).alias("tile_col"), ((row - (up - dr) * side) * (side + 1) + col - (left - dc) * side).cast("int").alias("at"))
    top, first = (row % side == 0) & (row > 0), (col % side == 0) & (col > 0)
    copies = F.array_compact(F.array(in_tile(0, 0), F.when(top, in_tile(1, 0)), F.when(first, in_tile(0, 1)), F.when(top & first, in_tile(1, 1))))

    def dense(group: pa.Table) -> pa.Table:
        values, there = np.zeros((side + 1) ** 2), np.zeros((side + 1) ** 2, bool)
        at, value = group.column("at").to_numpy(), group.column("value")
        values[at] = value.fill_null(0.0).to_numpy()
        there[at] = ~value.is_null().to_numpy()
        return pa.table({"tile_row": group.column("tile_row").slice(0, 1), "tile_col": group.column("tile_col").slice(0, 1), "values": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=~there))})

    spread = cells.select(F.explode(copies).alias("c"), real(F.col("value")).alias("value")).select("c.*", "value")
    return spread.groupBy("tile_row", "tile_col").applyInArrow(dense, "tile_row long, tile_col long, values array<double>")


def _corners(at: Column, side: int) -> list[Column]:
    """Four neighbours in a tile's values, from the upper left one's place."""
    return [F.get("values", at + step).alias(name) for name, step in (("tl", 0), ("tr", 1), ("bl", side + 1), ("br", side + 2))]


def squares(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """Each cell with its right, lower and diagonal neighbour: tl, tr, bl, br. One shuffle; whole squares only."""

    def square(i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), (i % side).cast("int")
        return F.struct((F.col("tile_row") * side + r).alias("row"), (F.col("tile_col") * side + c).alias("col"), *_corners(r * (side + 1) + c, side))

    every = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), square)
    whole = F.filter(every, lambda s: s.tl.isNotNull() & s.tr.isNotNull() & s.bl.isNotNull() & s.br.isNotNull())
    return tiles(cells, side).select(F.inline(whole))


def contour_segments(cells: DataFrame, levels: int) -> DataFrame:
    """Marching squares: level, x1, y1, x2, y2 in columns and rows. Level k of n lies at min + span k / (n + 1); a cell has one
    segment where two of its sides are crossed, two where all four are."""
    limits = cells.agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    marks = cells.sparkSession.range(1, levels + 1).crossJoin(F.broadcast(limits)).select(F.col("id").alias("k"), (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("id") / (levels + 1)).alias("level"))
    met = squares(cells).crossJoin(F.broadcast(marks))
    z = F.col("level")

    def cross(a: str, b: str, x: Column, y: Column, across: bool) -> Column:
        p, q = F.col(a), F.col(b)
        t = F.try_divide(z - p, q - p)
        point = F.struct((x + t if across else x).alias("x"), (y if across else y + t).alias("y"))
        return F.when((p < z) != (q < z), point)

    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    sides = F.array(cross("tl", "tr", col, row, True), cross("tr", "br", col + 1, row, False), cross("bl", "br", col, row + 1, True), cross("tl", "bl", col, row, False))
    met = met.withColumn("p", F.filter(sides, lambda s: s.isNotNull())).where(F.size("p") >= 2)
    met = met.select("k", "level", "row", "col", F.explode(F.expr("transform(sequence(0, size(p) - 2, 2), i -> struct(p[i] as a, p[i + 1] as b))")).alias("s"))
    return met.select("k", "level", "row", "col", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def bilinear(cells: DataFrame, places: DataFrame, side: int = SIDE) -> DataFrame:
    """Values between cells: places (fx, fy in columns and rows, kept inside the grid) with value. A place meets its tile, once, and
    takes its four neighbours from there; places without four are left out."""
    size = cells.agg((F.max("row") - 1).alias("_r"), (F.max("col") - 1).alias("_c"))
    at = places.crossJoin(F.broadcast(size))
    at = at.withColumns({"_col": F.greatest(F.lit(0), F.least(F.floor("fx"), F.col("_c"))).cast("long"), "_row": F.greatest(F.lit(0), F.least(F.floor("fy"), F.col("_r"))).cast("long")})
    at = at.withColumns({"_tr": F.floor(F.col("_row") / side), "_tc": F.floor(F.col("_col") / side)})
    place = ((F.col("_row") % side) * (side + 1) + F.col("_col") % side).cast("int")
    met = at.join(tiles(cells, side), (F.col("_tr") == F.col("tile_row")) & (F.col("_tc") == F.col("tile_col")))
    met = met.select(*places.columns, "_row", "_col", *_corners(place, side)).dropna(subset=["tl", "tr", "bl", "br"])
    tx, ty = F.col("fx") - F.col("_col"), F.col("fy") - F.col("_row")
    top = F.col("tl") * (1 - tx) + F.col("tr") * tx
    low = F.col("bl") * (1 - tx) + F.col("br") * tx
    return met.withColumn("value", top * (1 - ty) + low * ty).select(*places.columns, "value")


def life_step(alive: DataFrame, width: int, height: int) -> DataFrame:
    """Living cells (x, y) of the next generation on a torus: three neighbours, or two for a cell that lives. Every living cell
    adds one to its neighbours; counts are added up before the shuffle."""
    around = F.array(*(F.struct(F.pmod(F.col("x") + dx, F.lit(width)).alias("x"), F.pmod(F.col("y") + dy, F.lit(height)).alias("y"), F.lit(int((dx, dy) != (0, 0))).alias("near")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    counted = alive.select(F.explode(around).alias("c")).groupBy("c.x", "c.y").agg(F.sum("c.near").alias("near"), F.max(1 - F.col("c.near")).alias("lives"))
    return counted.where("near = 3 or near = 2 and lives = 1").select("x", "y")
