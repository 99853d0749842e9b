"""Readers, statistics and trees that are built for inputs no task holds, on small cases with small parts."""

import contextlib
import io
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import ranking, selection
from lattica.operators import charts, grid, rows, trees
from lattica.sources import files, heads, json_documents
from lattica.table import ROW, TableError


@contextlib.contextmanager
def small_ranges(spark, size):
    """Files are read in ranges of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def table_by_hand(text):
    records = json.loads(text)
    names = list(dict.fromkeys(k for r in records for k in r))
    number = {n: all(json_documents.numeric(r.get(n)) for r in records) for n in names}
    return names, [tuple(float(r[n]) if number[n] else json_documents.text_of(r.get(n)) for n in names) for r in records]


def made_up(r, depth=0):
    kind = r.randrange(6 if depth < 2 else 4)
    if kind == 0:
        return r.choice([0, -1, 2.5, 1e300, 10**400, 1e-7, True, None])
    if kind < 4:
        return "".join(r.choice(['"', "\\", ",", "[", "]", "{", "}", "\n", "\t", "é", "😀", "a", " ", ":", "\\\\\"", "▁"]) for _ in range(r.choice([0, 1, 3, 40])))
    return [made_up(r, depth + 1) for _ in range(r.randrange(3))] if kind == 4 else {made_up(r, 9) if r.random() < 0.2 else f"k{i}": made_up(r, depth + 1) for i in range(r.randrange(3)) if i >= 0}


def documents():
    r = random.Random(11)
    yield "plain", json.dumps([{"a": i, "b": f"x{i}", "c": i / 4} for i in range(40)])
    yield "late keys", '﻿ [ {"a": 1} , {"b":"2","a":3},{"c":null, "a":4,"c":"\\u0022,"} ]\n'
    yield "one", '[{"a":"' + "x,y" * 300 + '"}]'
    for k in range(2):
        yield f"random {k}", json.dumps([{"n": r.random(), **{f"k{j}": made_up(r) for j in range(r.randrange(4))}} for _ in range(40)], ensure_ascii=bool(k % 2), indent=k or None)


def test_json_documents_in_ranges(spark, tmp_path):
    for k, (name, text) in enumerate(documents()):
        path = tmp_path / f"{k}.json"
        path.write_text(text, encoding="utf-8")
        with small_ranges(spark, max(20, path.stat().st_size // 5)):
            t = files.load_file(spark, str(path))
            got = [tuple(x)[1:] for x in t.df.select(ROW, *(f"`{c}`" for c in t.columns)).orderBy(ROW).collect()]
        names, wanted = table_by_hand(text.lstrip("﻿"))
        assert list(t.columns) == names and got == wanted, name


def test_json_documents_in_a_folder_and_back(spark, tmp_path):
    df = spark.range(60).select("id", F.concat(F.lit('",[{\\'), "id").alias("s"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    json_documents.write_documents(df.repartitionByRange(3, "id"), str(tmp_path / "docs"))
    with small_ranges(spark, 400):
        got = json_documents.record_table(spark, str(tmp_path / "docs")).df.orderBy(ROW).collect()
    assert [(r[ROW], r.id, r.s, r.n) for r in got] == [(i, float(i), f'",[{{\\{i}', "" if i % 2 else str(i)) for i in range(60)]


@pytest.mark.parametrize("text", ["", "[]", " [ ] ", "3", '"a"', "[1,2]", '[{"a":1},[2]]', '[{"a":1}', '[{"a":NaN}]', "{}", '{"columns":[]}', '{"columns":[{"name":"a","data":[1]},{"name":"b","data":[]}]}', '[{"a":1},]'])
def test_json_that_is_no_table(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception) as e:
        json_documents.json_file(spark, str(tmp_path / "x.json")).df.collect()
    assert isinstance(e.value, TableError) or "JSON" in str(e.value) or "Expecting" in str(e.value)


def test_json_columns(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"columns": [{"name": "a b", "data": [1, 2.5, 3]}, {"data": ["x", None, True], "name": "t"}]}))
    t = files.load_file(spark, str(tmp_path / "x.json"))
    assert [tuple(r) for r in t.df.orderBy(ROW).collect()] == [(0, 1.0, "x"), (1, 2.5, ""), (2, 3.0, "true")] and list(t.columns) == ["a b", "t"]


# first bytes of files


def jpeg(width, height, before):
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", n + 2) + bytes(n) for n in before) + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes(300)


IMAGES = {
    "a.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 70_000) + bytes(9), (640, 70_000)),
    "b.gif": (b"GIF89a" + struct.pack("<HH", 3, 65_535) + bytes(5), (3, 65_535)),
    "c.webp": (b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(4) + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 320 | 0x4000, 200), (320, 200)),
    "d.webp": (b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 99 | 499 << 14) + bytes(9), (100, 500)),
    "e.webp": (b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (1023).to_bytes(3, "little") + (70_000).to_bytes(3, "little") + bytes(9), (1024, 70_001)),
    "f.jpg": (jpeg(800, 600, [10, 65_000, 65_000, 65_000]), (800, 600)),
    "g.jpg": (b"\xff\xd8\xff\xda" + bytes(50), None),
    "h.png": (b"\x89PNG\r\n\x1a\n", None),
    "i.txt": (b"%PDF-1.4 and more", None),
    "j.csv": (b"", None),
}


def test_heads_of_files(spark, tmp_path):
    for name, (content, _) in IMAGES.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "_hidden.png").write_bytes(IMAGES["a.png"][0])
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "k.gif").write_bytes(IMAGES["b.gif"][0])
    got = {r.path.rsplit("/", 1)[1]: r for r in heads.file_heads(spark, f"file://{tmp_path}").collect()}
    assert {n: (r.width, r.height) if r.width is not None else None for n, r in got.items()} == {n: size for n, (_, size) in IMAGES.items()}
    assert all(bytes(r.head) == IMAGES[n][0][:32] and r.length == len(IMAGES[n][0]) for n, r in got.items())
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {n: s for n, (_, s) in IMAGES.items() if s}
    formats = {r.path.rsplit("/", 1)[1]: r.formats for r in files.formats_in(spark, str(tmp_path)).collect()}
    assert formats["i.txt"] == ["pdf", "text"] and formats["a.png"] == ["png"] and formats["j.csv"] == ["csv"] and formats["c.webp"] == ["webp"]
    spark.sql("CREATE TEMP VIEW heads_of_files USING file_heads OPTIONS (path '" + str(tmp_path) + "', recursive 'true', filesPerPartition '3')")
    assert spark.sql("SELECT count(*) FROM heads_of_files").first()[0] == len(IMAGES) + 1
    spark.catalog.dropTempView("heads_of_files")


def test_headers_alone_are_read():
    """What is read of a file does not grow with it."""

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            self.n += len(got)
            return got

    small, large = Counted(jpeg(8, 9, [50] * 3)), Counted(jpeg(8, 9, [65_000] * 3) + bytes(1 << 20))
    for f in (small, large):
        assert heads.image_size(f, f.getvalue()[:32]) == (8, 9)
    assert small.n == large.n < 64


# order statistics


@pytest.mark.parametrize("keep_nan", [False, True])
def test_selection_against_sorting(spark, keep_nan):
    r = np.random.default_rng(3)
    groups = {
        "normal": r.normal(size=500), "hot": np.concatenate([np.full(400, 7.5), r.normal(size=100)]), "one": np.array([2.0]), "two": np.array([-1.0, 1.0]),
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 300), -(10.0 ** r.uniform(-300, 300, 300))]), "powers": 2.0 ** np.arange(-1074, 1024, 3.0), "close": 1 + np.arange(200) * 2.0**-52,
        "odd": np.array([math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, math.inf, math.nan]), "nan": np.array([math.nan, math.nan]), "ends": np.array([math.inf, -math.inf, -math.inf]),
    }
    data = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    places = {"first": F.lit(0), "mid": F.floor((F.col("n") - 1) * 0.5), "up": F.ceil((F.col("n") - 1) * 0.5), "q": F.floor(F.col("n") * 0.9), "last": F.col("n") - 1, "none": F.col("n")}
    got = {x.g: x for x in selection.selected(df, "g", "v", places, keep_nan).collect()}
    wanted = {}
    for g, x in groups.items():
        x = np.sort(x if keep_nan else x[~np.isnan(x)])
        if len(x):
            n = len(x)
            wanted[g] = (n, x[0], x[(n - 1) // 2], x[n // 2], x[math.floor(n * 0.9)], x[-1])
    assert got.keys() == wanted.keys()
    for g, want in wanted.items():
        assert np.array_equal(np.array(tuple(got[g])[1:7], float), np.array(want, float), equal_nan=True), (g, got[g], want)
        assert got[g].none is None
    assert selection.selected(df.limit(0), "g", "v", places).count() == 0


# places, means, density


def test_places_in_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    with small_ranges(spark, 700):
        df = spark.read.parquet(str(tmp_path / "t"))
        assert all(r.rn == r.id + 1 for r in ranking.in_file_order(df).collect())
        taken = rows.every_nth(df, None, 37)
        assert sorted(r.id for r in taken.collect()) == list(range(0, 1000, 37))
        plan = taken._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and plan.count("Exchange") == plan.count("BroadcastExchange")
        assert sorted(r.id for r in rows.resampled(df, None, 10).collect()) == list(range(0, 1000, 100))


@pytest.mark.parametrize("width", [0, 1, 5, 6, 400])
def test_moving_average_in_blocks(spark, width, monkeypatch):
    r = random.Random(width)
    data = [(g, i, r.choice([1.0, 2.5, -3.0, None, math.nan if i > 240 else 4.0, math.inf if i > 260 else 0.0])) for g in "ab" for i in range(270)]
    monkeypatch.setattr(charts, "max", lambda *x: 25 if x[0] == 4096 and width < 10 else max(*x), raising=False)  # blocks of 25 rows
    got = {(x.g, x.i): x.smooth for x in charts.moving_average(spark.createDataFrame(data, "g string, i long, v double").repartition(3), "i", "v", width, ["g"]).collect()}
    half = width // 2
    for g in "ab":
        own = [v for k, _, v in data if k == g]
        for i in range(270):
            near = [v for v in own[max(0, i - half) : i + half + 1] if v is not None]
            want = sum(near) / len(near) if near else None
            assert got[g, i] is None and want is None or got[g, i] == pytest.approx(want, nan_ok=True), (g, i)
    whole = spark.createDataFrame([(i, float(i)) for i in range(100)], "i long, v double")
    assert [x.smooth for x in charts.moving_average(whole, "i", "v", 3).orderBy("i").collect()] == [0.5, *map(float, range(1, 99)), 98.5]


def test_density_against_the_formula(spark):
    r = np.random.default_rng(1)
    data = {"a": r.normal(size=80), "b": r.uniform(5, 6, 30), "c": np.array([2.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in data.items() for v in x] + [("a", math.nan)], "g string, v double")
    low, high = min(x.min() for x in data.values()), max(x.max() for x in data.values())
    got = charts.kernel_density(df, "g", "v", points=9).collect()
    assert len(got) == 27
    for x in got:
        own = data[x.g]
        h = (own.std() or 1) * 1.06 * len(own) ** -0.2
        at = low - (high - low) * 0.05 + (high - low) * 1.1 * x.point / 8
        assert x.x == pytest.approx(at) and x.density == pytest.approx(np.exp(-0.5 * ((at - own) / h) ** 2).sum() / (len(own) * h))


def test_sums_before_rows_of_groups_in_several_parts(spark):
    r = random.Random(2)
    data = [(g, i, r.random() * 10 ** r.randrange(6)) for g in ("a", None, "c") for i in range(150)]
    before, wanted = {}, {}
    for g, i, w in data:
        wanted[g, i] = before.get(g, 0.0)
        before[g] = wanted[g, i] + w
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.sums_before(spark.createDataFrame(data, "g string, i long, w double").repartition(3), ["i"], "w", ["g"], "s").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data) and all(x.s == pytest.approx(wanted[x.g, x.i]) for x in got)


# grids


@pytest.mark.parametrize("side", [1, 3, 64])
def test_grids_in_tiles(spark, side):
    """Whole squares and values between cells, also across tiles, with cells missing."""
    r = np.random.default_rng(side)
    z = r.normal(size=(8, 11))
    missing = {(2, 3), (7, 10)}
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(8) for j in range(11) if (i, j) not in missing], "row long, col int, value double").repartition(3)
    got = {(x.row, x.col): (x.tl, x.tr, x.bl, x.br) for x in grid.squares(cells, side).collect()}
    whole = [(i, j) for i in range(7) for j in range(10) if not {(i, j), (i, j + 1), (i + 1, j), (i + 1, j + 1)} & missing]
    assert got == {(i, j): (z[i, j], z[i, j + 1], z[i + 1, j], z[i + 1, j + 1]) for i, j in whole}
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(r.uniform(-1, 11, (40, 2)))] + [(40, 3.0, 3.0), (41, 10.0, 7.0)]
    found = {x.id: x.value for x in grid.bilinear(cells, spark.createDataFrame(places, "id long, fx double, fy double"), side).collect()}
    wanted = {}
    for k, x, y in places:
        i, j = min(6, max(0, math.floor(y))), min(9, max(0, math.floor(x)))
        if (i, j) in got:
            a, b, c, d = got[i, j]
            wanted[k] = (a * (1 - (x - j)) + b * (x - j)) * (1 - (y - i)) + (c * (1 - (x - j)) + d * (x - j)) * (y - i)
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)


# trees


def tree_by_hand(parents, sizes):
    children = {}
    for n, p in parents.items():
        children.setdefault(p if p in parents else None, []).append(n)
    out, at = {}, 0
    stack = [(n, 1) for n in sorted(children.get(None, []), reverse=True)]
    order = []
    while stack:
        n, depth = stack.pop()
        order.append((n, depth, at))
        at += 1
        stack += [(c, depth + 1) for c in sorted(children.get(n, []), reverse=True)]
    total, leaves = {}, {}
    for n, depth, index in reversed(order):
        own = children.get(n, [])
        total[n] = max(sizes[n], sum(total[c] for c in own))
        leaves[n] = sum(leaves[c] for c in own) if own else 1
        out[n] = (depth, index, total[n], leaves[n])
    return out


def random_trees():
    r = random.Random(4)
    names = [f"n{i:04}" for i in range(300)]
    r.shuffle(names)
    yield "random", {n: (names[r.randrange(i)] if i and r.random() < 0.97 else None) for i, n in enumerate(names)}
    yield "star", {f"s{i:04}": "s0000" if i else None for i in range(300)}
    yield "brush", {f"b{i:04}": (f"b{i - 1:04}" if i % 10 else f"b{i - 10:04}" if i else None) for i in range(200)} | {"x": "y", "y": "x", "z": "x"}


@pytest.mark.parametrize("name,parents", list(random_trees()))
def test_trees_against_walking_them(spark, name, parents):
    r = random.Random(9)
    sizes = {n: float(r.choice([0, 1, 5, 60])) for n in parents}
    placed = trees.depths(spark.createDataFrame([(n, p, sizes[n]) for n, p in parents.items()], "label string, parent string, size double").repartition(3))
    got = {x.label: [x.depth] for x in placed.collect()}
    for found in (trees.preorder(placed).select("label", "index"), trees.rolled_up(placed).select("label", "total"), trees.leaf_counts(placed)):
        for x in found.collect():
            got[x.label].append(x[1])
    gone = {"x", "y", "z"} & parents.keys()
    assert {n: tuple(v) for n, v in got.items()} == tree_by_hand({n: p for n, p in parents.items() if n not in gone}, sizes)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, steps = 3000, []
    written = trees.written
    monkeypatch.setattr(trees, "written", lambda df, *a: steps.append(1) or written(df, *a))
    placed = trees.depths(spark.range(n).select(F.format_string("n%05d", "id").alias("label"), F.when(F.col("id") > 0, F.format_string("n%05d", F.col("id") - 1)).alias("parent"), F.lit(1.0).alias("size")))
    assert placed.agg(F.max("depth"), F.sum("depth")).first()[:] == (n, n * (n + 1) // 2) and len(steps) <= 16
    steps.clear()
    assert trees.rolled_up(placed).agg(F.min("total"), F.sum("total")).first()[:] == (1.0, float(n)) and len(steps) <= 4 * 15
