"""Hierarchies given as label, parent and size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.ranking import ranked, sums_before
from ..functions.storage import counted, erased, passed_on, written

CHUNK = 1 << 18  # rows of a task that are held at once
FEW = 1 << 16  # rows that are broadcast at most


def tree_nodes(rows: DataFrame, label: str = "label", parent: str = "parent", size: str = "size") -> DataFrame:
    """One node for each label: sizes add up, an empty parent is the root's, null."""
    up = F.when(F.trim(F.coalesce(F.col(parent), F.lit(""))) != "", F.trim(F.col(parent)))
    return rows.groupBy(F.trim(F.col(label)).alias("label")).agg(F.max(up).alias("parent"), F.sum(F.coalesce(F.col(size).cast("double"), F.lit(0.0))).alias("size"))


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int = 64 << 20) -> Iterator[pa.Table]:
    """A task's rows as tables of at most so many rows and bytes, or of one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(x.num_rows for x in held) + batch.num_rows > rows or sum(x.nbytes for x in held) + batch.nbytes > size):
            yield pa.Table.from_batches(held)
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def places(chunk: pa.Table, of: str) -> np.ndarray:
    """Where the chunk has the row whose label is each row's `of`, or -1."""
    at = pc.index_in(chunk[of], chunk["label"].combine_chunks(), skip_nulls=True)
    return np.array(at.fill_null(-1), dtype=np.int64)


def replaced(chunk: pa.Table, **columns: pa.Array | np.ndarray) -> pa.Table:
    """The chunk with these columns for those of the same names, or after them."""
    for name, values in columns.items():
        k = chunk.schema.get_field_index(name)
        values = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, chunk.schema.field(k).type if k >= 0 else None)
        chunk = chunk.set_column(k, name, values) if k >= 0 else chunk.append_column(name, values)
    return chunk


def in_tasks(df: DataFrame, run: Callable[[pa.Table], pa.Table], more: str) -> DataFrame:
    """The rows, changed chunk by chunk where they lie, with further columns. How rows are dealt over chunks must not matter."""
    rows = CHUNK

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, rows):
            yield from run(chunk).to_batches()

    return df.mapInArrow(each, StructType([*(StructField(f.name, f.dataType) for f in df.schema), *StructType.fromDDL(more)]))


def climbed(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Each node's goal becomes that of its highest ancestor in the chunk, its sums those of the path up to there; _top tells nodes
    whose goal lies elsewhere and was their own. Nodes on or below a cycle within the chunk stay as they are."""

    def run(chunk: pa.Table) -> pa.Table:
        up = places(chunk, "goal")
        outside = np.array(chunk["goal"].is_valid()) & (up < 0)
        if any(chunk[n].null_count for n in names):
            return replaced(chunk, _top=np.array(chunk["goal"].is_valid()))
        at, last, own = up.copy(), np.arange(len(up)), [np.array(chunk[n]) for n in names]
        sums = [s.copy() for s in own]
        for _ in range(len(up).bit_length() + 1):
            on = np.flatnonzero(at >= 0)
            if not len(on):
                break
            to = at[on]
            for s in sums:
                s[on] += s[to]
            last[on], at[on] = last[to], at[to]
        ring = at >= 0
        last[ring] = np.flatnonzero(ring)
        return replaced(chunk, goal=chunk["goal"].combine_chunks().take(pa.array(last)), **{n: np.where(ring, o, s) for n, o, s in zip(names, own, sums)}, _top=outside | ring)

    return run


def path_sums(nodes: DataFrame, weights: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """label, the columns to keep, and the sums of the weights of all nodes from the root to each node. `parent` is null for roots, or
    no node's label. First tasks add up the stretches of paths that lie in one chunk of their rows; what is left goes by pointer
    doubling: each round a node takes over what its present goal has summed up, and that one's goal, so that a path of n stretches
    takes about log2(n) rounds, and where rows came with their parents, hardly a row is shuffled. Nodes on a cycle, and those below
    one, reach no root: after as many rounds as any path needs, they go."""
    names, keep = list(weights), list(keep or [])
    left = {"left": F.count_if(F.col("goal").isNotNull())}
    kind = dict(nodes.dtypes)["label"]
    first = in_tasks(nodes.select("label", F.col("parent").cast(kind).alias("goal"), *(w.alias(n) for n, w in weights.items()), *(F.col(c).alias(f"keep_{c}") for c in keep)), climbed(names), "_top boolean")
    whole, seen = counted(first, **left, goals=F.count_if("_top"))
    kept = [F.col(f"keep_{c}").alias(c) for c in keep]
    if not seen["left"]:
        return passed_on(whole.select("label", *kept, *names), whole)
    goals = whole.where("_top").select("goal")
    step, few = whole.select("label", "goal", *names), seen["goals"]
    rounds = (seen["goals"] + 1).bit_length() + 1
    steps, ended = [whole], step.where("goal is null")
    while rounds and seen["left"]:
        rounds -= 1
        open_ = step.where("goal is not null")
        ahead = ended.unionByName(open_).select(F.col("label").alias("goal"), F.col("goal").alias("_next"), *(F.col(n).alias(f"_{n}") for n in names), F.lit(True).alias("_known"))
        if few <= FEW:
            ahead = F.broadcast(ahead.join(F.broadcast(goals), "goal", "left_semi"))
        pairs = open_.join(ahead, "goal", "left")  # a goal that isn't found is no node: the path ends before it
        step, seen = counted(pairs.select("label", F.col("_next").alias("goal"), *(F.when(F.col("_known"), F.col(n) + F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names)), **left)
        steps.append(step)
        ended = ended.unionByName(step.where("goal is null"))
        goals, few = step.where("goal is not null").select("goal"), seen["left"]
    if not keep:
        return passed_on(ended.drop("goal"), *steps)
    done = whole.where("goal is null").select("label", *kept, *names)
    later = steps[1].where("goal is null")
    for s in steps[2:]:
        later = later.unionByName(s.where("goal is null"))
    return passed_on(done.unionByName(whole.where("goal is not null").select("label", *kept).join(later.drop("goal"), "label")), *steps)


def depths(nodes: DataFrame) -> DataFrame:
    """Adds depth, 1 for nodes without a known parent. Nodes on a cycle, or below one, have none and go."""
    others = [c for c in nodes.columns if c != "label"]
    found = path_sums(nodes, {"depth": F.lit(1).cast("long")}, others)  # on cycles it grows beyond any int before they go
    return passed_on(found.select(*nodes.columns, F.col("depth").cast("int").alias("depth")), found)


def children(chunk: pa.Table) -> pa.Table:
    """Adds open, how many children of each node the chunk has, and up, whether a node's parent is elsewhere."""
    at = places(chunk, "parent")
    return replaced(chunk, open=np.bincount(at[at >= 0], minlength=len(at)), up=np.array(chunk["parent"].is_valid()) & (at < 0))


def gathered(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Nodes without open children are done and have their results; their parents in the chunk take them, and so on. The parents of
    done nodes that stay in the column are elsewhere and yet to take them."""

    def run(chunk: pa.Table) -> pa.Table:
        at, left, done = places(chunk, "parent"), np.array(chunk["open"]), np.zeros(len(chunk), bool)
        own = [np.array(chunk[f"own_{n}"].fill_null(math.nan)) for n in names]
        floors = [np.array(chunk[f"floor_{n}"].fill_null(-math.inf)) for n in names]
        found = [np.zeros(len(chunk)) for _ in names]
        ready = np.flatnonzero(left == 0) if not any(chunk[f"own_{n}"].null_count for n in names) else done[:0]
        while len(ready):
            done[ready] = True
            inner = ready[at[ready] >= 0]
            for v, f, o in zip(found, floors, own):
                v[ready] = np.maximum(f[ready], o[ready])
                np.add.at(o, at[inner], v[inner])
            np.subtract.at(left, at[inner], 1)
            above = np.unique(at[inner])
            ready = above[left[above] == 0]
        gone = pa.array(done)
        inside = pa.array(done & (at >= 0))
        parts = {"parent": pc.if_else(inside, pa.scalar(None, chunk["parent"].type), chunk["parent"]), "open": left}
        for n, o, v in zip(names, own, found):
            rest = chunk[f"own_{n}"] if chunk[f"own_{n}"].null_count else o
            parts |= {f"own_{n}": pc.if_else(gone, pa.scalar(None, pa.float64()), rest), f"floor_{n}": pc.if_else(gone, pa.scalar(None, pa.float64()), chunk[f"floor_{n}"]), f"got_{n}": pa.array(v, mask=~done)}
        return replaced(chunk, **parts, done=gone)

    return run


def given(active: DataFrame, found: DataFrame, names: list[str], n: int) -> DataFrame:
    """The open nodes with the results of n done ones added to what their parents have of their own."""
    sums = found.where("parent is not null").groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("_done"), *(F.sum(m).alias(f"_{m}") for m in names))
    got = active.join(F.broadcast(sums) if n <= FEW else sums, "label", "left")
    return got.withColumns({"open": F.col("open") - F.coalesce("_done", F.lit(0)), **{f"own_{m}": F.col(f"own_{m}") + F.coalesce(f"_{m}", F.lit(0.0)) for m in names}}).drop("_done", *(f"_{m}" for m in names))


def folded(placed: DataFrame, measures: dict[str, tuple[Column | None, Column]]) -> DataFrame:
    """label, and for each measure (floor, own) the greater of its floor and its own value plus its children's results; no floor: that
    sum alone. From the leaves up. First tasks fold what lies in one chunk of their rows, as long as that at least halves the open
    nodes. The rest goes by contraction: each round, nodes whose children are all known give their result to their parent, and of
    nodes with one open child left, where a result is max(a, b + the child's), chains are halved by putting these functions one into
    the other. So long chains and wide stars take about log2(n) rounds; a parent's children meet in a sum that tasks begin before the
    shuffle."""
    names = list(measures)
    kind = dict(placed.dtypes)["label"]
    rows = placed.select("label", F.when(F.col("depth") > 1, F.col("parent").cast(kind)).alias("parent"), *(F.lit(-math.inf).alias(f"floor_{n}") if floor is None else floor.cast("double").alias(f"floor_{n}") for n, (floor, _) in measures.items()), *(own.cast("double").alias(f"own_{n}") for n, (_, own) in measures.items()))
    marked, seen = counted(in_tasks(rows, children, "open long, up boolean"), n=F.count("*"), up=F.count_if("up"))
    active = marked.drop("up")
    if seen["up"]:
        more = marked.where("up").groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("_more"))
        active = active.join(F.broadcast(more) if seen["up"] <= FEW else more, "label", "left").withColumn("open", F.col("open") + F.coalesce("_more", F.lit(0))).drop("_more")
    steps, known, kept, n = [marked], [], [], seen["n"]
    while n:
        part, seen = counted(in_tasks(active, gathered(names), f"{', '.join(f'got_{m} double' for m in names)}, done boolean"), n=F.count_if(~F.col("done")), up=F.count_if(F.col("done") & F.col("parent").isNotNull()))
        kept.append(part)
        found = part.where("done").select("label", "parent", *(F.col(f"got_{m}").alias(m) for m in names))
        known.append(found)
        active = part.where("not done").drop("done", *(f"got_{m}" for m in names))
        active = given(active, found, names, seen["up"]) if seen["up"] else active
        if 2 * seen["n"] > n:
            break
        n = seen["n"]
    if seen["n"]:
        none = [F.lit(None).cast(kind).alias("goal"), *(F.lit(None).cast("double").alias(f"{x}_{m}") for m in names for x in ("a", "b"))]
        left = {"n": F.count("*"), "single": F.count_if((F.col("open") == 1) | F.col("goal").isNotNull())}
        active, seen = counted(active.select("*", *none), **left)
        steps.append(active)
        last = None
        while seen["n"]:
            found = active.where("open = 0").select("label", "parent", *(F.greatest(f"floor_{n}", f"own_{n}").alias(n) for n in names))
            if last is not None:
                ends = last.select(F.col("label").alias("goal"), *(F.col(n).alias(f"_{n}") for n in names))
                found = found.unionByName(active.where("open > 0").join(ends, "goal").select("label", "parent", *(F.greatest(F.col(f"a_{n}"), F.col(f"b_{n}") + F.col(f"_{n}")).alias(n) for n in names)))
            last, got = counted(found, n=F.count("*"))
            known.append(last)
            kept.append(last)
            if got["n"] == seen["n"]:
                break
            active, seen = counted(given(active.join(last.select("label"), "label", "left_anti"), last, names, got["n"]), **left)
            steps.append(active)
            if seen["single"]:
                active, more = shortened(active, names)
                steps += [*more, active]
    erased(*steps)
    if not known:
        return placed.select("label", *(F.lit(0.0).alias(n) for n in names)).limit(0)
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    return passed_on(out.select("label", *names), *kept)


def shortened(active: DataFrame, names: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Open nodes of `folded`: those with one open child now have it as their goal, and goals that have a goal themselves are passed
    by. Also returns what was written in between."""
    only = active.where("parent is not null").groupBy(F.col("parent").alias("label")).agg(F.min("label").alias("_only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    new = F.col("goal").isNull() & (F.col("open") == 1)
    own = {f"{x}_{n}": F.when(new, F.col(f"{y}_{n}")).otherwise(F.col(f"{x}_{n}")) for n in names for x, y in (("a", "floor"), ("b", "own"))}
    named = written(active.join(only, "label", "left").withColumns(own).withColumn("goal", F.when(new, F.col("_only")).otherwise(F.col("goal"))).drop("_only"))
    inner = named.where("goal is not null").select(F.col("label").alias("goal"), F.col("goal").alias("_goal"), *(F.col(f"{x}_{n}").alias(f"_{x}_{n}") for n in names for x in ("a", "b")))
    into = {f"a_{n}": F.when(F.col("_goal").isNull(), F.col(f"a_{n}")).otherwise(F.greatest(F.col(f"a_{n}"), F.col(f"b_{n}") + F.col(f"_a_{n}"))) for n in names}
    into |= {f"b_{n}": F.col(f"b_{n}") + F.coalesce(f"_b_{n}", F.lit(0.0)) for n in names}
    return written(named.join(inner, "goal", "left").withColumns({**into, "goal": F.coalesce("_goal", "goal")}).drop("_goal", *(f"_{x}_{n}" for n in names for x in ("a", "b")))), [named]


def rolled_up(placed: DataFrame) -> DataFrame:
    """Adds total: a node's own size or the sum of its children's totals, whichever is more."""
    return placed.join(folded(placed, {"total": (F.col("size"), F.lit(0.0))}), "label")


def leaf_counts(placed: DataFrame) -> DataFrame:
    """label and leaves: how many nodes without children lie below (a leaf has itself)."""
    inner = placed.where("depth > 1").select(F.col("parent").alias("label"), F.lit(0).alias("_leaf")).distinct()
    rows = placed.join(inner, "label", "left").withColumn("_leaf", F.coalesce("_leaf", F.lit(1)))
    return folded(rows, {"leaves": (None, F.col("_leaf"))}).select("label", F.col("leaves").cast("long").alias("leaves"))


def preorder(placed: DataFrame) -> DataFrame:
    """Adds index: the depth-first number, children by their labels. What a node adds to its parent's number, one and the subtrees of
    its earlier siblings, comes from ranks that deal siblings over tasks; sums along the paths to the root give the numbers."""
    sizes = folded(placed, {"_n": (None, F.lit(1))}).withColumn("_n", F.col("_n").cast("long"))
    rows = placed.select("label", F.when(F.col("depth") > 1, F.col("parent")).alias("parent")).join(sizes, "label").withColumn("_up", F.struct("parent"))
    before = ranked(rows, "label", within=["_up"], rank="_upto", weight="_n")
    steps = before.select("label", "parent", (F.col("_upto") - F.col("_n") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("index"))
    return placed.join(path_sums(steps, {"index": F.col("index")}), "label")


def slices(totals: DataFrame) -> DataFrame:
    """Boxes of a treemap in the unit square: each node's box is cut among its children along its longer side, in proportion to
    their totals, the largest first. Level by level."""
    rows = totals.withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))
    every = rows.groupBy("parent").agg(F.sum("total").alias("_all"))
    rows = sums_before(rows, [F.desc("total"), F.asc("label")], "total", ["parent"], "_before")
    rows = rows.join(every, rows.parent.eqNullSafe(every.parent)).drop(every.parent)
    whole = F.when(F.col("_all") == 0, F.lit(1.0)).otherwise(F.col("_all"))
    rows = written(rows.withColumns({"_from": F.col("_before") / whole, "_part": F.col("total") / whole}).drop("_all", "_before"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    boxes, out = None, None
    for depth in range(1, deepest + 1):
        own = rows.where(F.col("depth") == depth)
        if boxes is None:
            own = own.withColumns({c: F.lit(v) for c, v in (("bx", 0.0), ("by", 0.0), ("bw", 1.0), ("bh", 1.0))})
        else:
            own = own.join(boxes.select(F.col("label").alias("parent"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh")), "parent")
        wide = F.col("bw") >= F.col("bh")
        place = {
            "x": F.when(wide, F.col("bx") + F.col("bw") * F.col("_from")).otherwise(F.col("bx")),
            "y": F.when(wide, F.col("by")).otherwise(F.col("by") + F.col("bh") * F.col("_from")),
            "w": F.when(wide, F.col("bw") * F.col("_part")).otherwise(F.col("bw")),
            "h": F.when(wide, F.col("bh")).otherwise(F.col("bh") * F.col("_part")),
        }
        boxes = written(own.withColumns(place).select("label", "parent", "depth", "total", "x", "y", "w", "h"))
        out = boxes if out is None else out.unionByName(boxes)
    return out if out is not None else rows.select("label", "parent", "depth", "total", *(F.lit(0.0).alias(c) for c in "xywh"))
