"""Pixel operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import collection, compose, measure, resample, slicing
from tessera.plans import planner


def px(spark, a, axes="yx"):
    rows = [(*map(int, k), float(v)) for k, v in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, ", ".join(f"{x} long" for x in axes) + ", v double")


def array(df, shape, axes="yx"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r["v"]
    return out


A = np.arange(15 * 11, dtype=float).reshape(15, 11) % 37


def test_slices(spark):
    df = px(spark, A)
    assert np.array_equal(array(slicing.slice_region(df, y=(2, 9), x=(3, -1)), A.shape)[2:9, 3:], A[2:9, 3:])
    assert slicing.slice_region(df, y=3).columns == ["x", "v"]
    assert slicing.scale_bounds(2.0, x=(3, 10), y=(0, -1), z=4) == {"x": (2, 5), "y": (0, -1), "z": 4}
    assert slicing.reorder([1, 2, 3], "xyz", "tzyx") == [0, 3, 2, 1]


def test_redimension_round_trip(spark):
    df = slicing.redimension(px(spark, A), "tczyx")
    assert df.columns == ["t", "c", "z", "y", "x", "v"]
    assert np.array_equal(array(slicing.redimension(df, "yx"), A.shape), A)


@pytest.mark.parametrize("h,w", [(4, 4), (15, 11), (20, 3)])
def test_tiles_round_trip(spark, h, w):
    packed = slicing.pack(px(spark, A), h, w)
    assert packed.count() == -(-15 // h) * -(-11 // w)
    assert np.array_equal(array(slicing.unpack(packed, h, w), A.shape), A)
    region = slicing.covering(packed, h, w, 5, 9, 2, 7)
    assert region.count() <= packed.count() and np.array_equal(array(slicing.slice_region(slicing.unpack(region, h, w), y=(5, 9), x=(2, 7)), A.shape)[5:9, 2:7], A[5:9, 2:7])


def test_grid_fill_and_shape(spark):
    sparse = px(spark, A).where("v > 20")
    assert np.array_equal(array(slicing.fill(sparse, {"y": 15, "x": 11}), A.shape), np.where(A > 20, A, 0))
    assert tuple(slicing.shape(px(spark, A), "yx").first()) == A.shape
    grid = slicing.tile_grid(spark.createDataFrame([(1, 300, 500), (2, 0, 5)], "image_id long, size_y long, size_x long"), 256, 256)
    assert sorted((r["ty"], r["tx"], r["h"], r["w"]) for r in grid.collect()) == [(0, 0, 256, 256), (0, 1, 256, 244), (1, 0, 44, 256), (1, 1, 44, 244)]


@pytest.mark.parametrize("h,w", [(15, 11), (18, 9), (10, 14), (20, 20), (1, 1)])
def test_reshape(spark, h, w):
    want = np.pad(A[:h, :w], ((0, max(0, h - 15)), (0, max(0, w - 11))), mode="edge")
    assert np.array_equal(array(slicing.reshape(px(spark, A), 15, 11, h, w), (h, w)), want)


def test_blocks(spark):
    df = px(spark, A[:14, :10])
    b = A[:14, :10].reshape(7, 2, 5, 2)
    assert np.allclose(array(resample.block_mean(df, 2, 2), (7, 5)), b.mean((1, 3)))
    assert np.allclose(array(resample.block_max(df, 2, 2), (7, 5)), b.max((1, 3)))
    padded = np.zeros((16, 12))
    padded[:15, :11] = A
    assert np.allclose(array(resample.block_mean_zero_padded(px(spark, A), 4, 4), (4, 3)), padded.reshape(4, 4, 3, 4).mean((1, 3)))
    assert np.array_equal(array(resample.stride(px(spark, A), 3, 2), (5, 6)), A[::3, ::2])


def area_matrix(old, new):
    s, m = old / new, np.zeros((new, old))
    for o in range(new):
        for i in range(old):
            m[o, i] = max(0, min(i + 1, (o + 1) * s) - max(i, o * s))
    return m / m.sum(1, keepdims=True)


def cubic_matrix(old, new, a=-0.75):
    m = np.zeros((new, old))
    for o in range(new):
        c = (o + 0.5) * old / new - 0.5
        for j in range(int(np.floor(c)) - 1, int(np.floor(c)) + 3):
            d = abs(c - j)
            w = (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0
            m[o, min(max(j, 0), old - 1)] += w
    return m


@pytest.mark.parametrize("h,w", [(7, 4), (15, 6), (5, 11), (1, 1)])
def test_area(spark, h, w):
    want = area_matrix(15, h) @ A @ area_matrix(11, w).T
    assert np.allclose(array(resample.resize(px(spark, A), 15, 11, h, w), (h, w)), want)


@pytest.mark.parametrize("h,w", [(30, 22), (23, 17), (15, 40)])
def test_cubic(spark, h, w):
    want = A
    want = cubic_matrix(15, h) @ want if h != 15 else want
    want = want @ cubic_matrix(11, w).T if w != 11 else want
    assert np.allclose(array(resample.resize(px(spark, A), 15, 11, h, w), (h, w)), want)


@pytest.mark.parametrize("sigma", [0.6, 1.0, 4.0])
def test_blur(spark, sigma):
    w = np.array(resample.gaussian(sigma))
    r = len(w) // 2
    rows = np.pad(A, ((r, r), (0, 0)), mode="symmetric")
    want = sum(w[k] * rows[k : k + 15] for k in range(2 * r + 1))
    cols = np.pad(want, ((0, 0), (r, r)), mode="symmetric")
    want = sum(w[k] * cols[:, k : k + 11] for k in range(2 * r + 1))
    assert np.allclose(array(resample.blur(px(spark, A), sigma, 15, 11), A.shape), want)


def test_pyramid(spark):
    a = A[:12, :8]
    levels = resample.pyramid(px(spark, a), 2)
    b = a.reshape(6, 2, 4, 2).mean((1, 3))
    assert np.allclose(array(levels.where("level = 1"), (6, 4)), b) and np.allclose(array(levels.where("level = 2"), (3, 2)), b.reshape(3, 2, 2, 2).mean((1, 3)))
    assert levels.where("level = 2").agg(F.avg("v")).first()[0] == pytest.approx(a.mean())
    assert np.array_equal(array(resample.pyramid(px(spark, a), 2, nearest=True).where("level = 2"), (3, 2)), a[::4, ::4])
    sizes = spark.createDataFrame([(1, 5, 7)], "image_id long, size_x long, size_y long")
    got = [(r["size_x"], r["size_y"]) for r in resample.pyramid_sizes(sizes, 4, 2.0).orderBy("level").collect()]
    assert got == [(max(round(5 / 2**k), 1), max(round(7 / 2**k), 1)) for k in (1, 2, 3, 4)]
    assert [r["size_x"] for r in resample.pyramid_sizes(sizes, 3, 2.0, truncate=True).orderBy("level").collect()] == [2, 1, 0]


def test_levels(spark):
    rows = [(1, k, 1024 >> k, 768 >> k) for k in range(5)]
    df = spark.createDataFrame(rows, "image_id long, level int, size_x long, size_y long")
    for target, want in ((1.0, 0), (0.6, 0), (0.5, 1), (0.3, 1), (0.1, 3), (2.0, 0), (0.01, 4)):
        got = planner.best_level(df.withColumn("target", F.lit(target))).first()
        assert got["level"] == want and got["factor_x"] == pytest.approx(target * 2**want)
    assert planner.best_size(df, 300, 300).first()["level"] == 1 and planner.best_size(df, 3000, 3000).first()["level"] == 0


def test_measures(spark):
    rng = np.random.default_rng(0)
    tiles = rng.integers(0, 255, (9, 1, 6, 5))
    df = px(spark, tiles, ("tile", "c", "y", "x"))
    assert np.allclose(array(measure.tiles_median(df), (1, 6, 5), "cyx")[0], np.median(tiles[:, 0], axis=0))
    q = measure.tiles_quantiles(df, [0.05, 0.9], 255.0)
    assert np.allclose(array(q.where("k = 1"), (1, 6, 5), "cyx")[0], np.quantile(tiles[:, 0], 0.9, axis=0) / 255)
    signal = np.abs(tiles[:, 0] - np.median(tiles[:, 0], axis=0)).mean((1, 2))
    assert {r["tile"] for r in measure.signal_filter(df, measure.tiles_median(df)).collect()} == set(np.flatnonzero(signal < signal.mean()).tolist())
    got = measure.quantiles(df, [0.25, 0.5], "tile").where("tile = 3").first()
    assert [got["q0"], got["q1"]] == pytest.approx(np.quantile(tiles[3], [0.25, 0.5]).tolist())
    assert measure.used_fraction(df).first()[0] == pytest.approx(((tiles >= 26) & (tiles <= 230)).mean())
    assert abs(measure.approximate_quantiles(df, [0.5]).first()[0] - np.median(tiles)) <= 3


def test_compare(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 255, (2, 8, 8)), rng.integers(0, 255, (2, 8, 8))
    x, y = px(spark, a, "cyx"), px(spark, b, "cyx")
    d = np.sqrt(((a - b) ** 2).sum(0))
    got = measure.compare(x, y, ["y", "x"], 255.0).first()
    assert tuple(got) == pytest.approx((d.max(), d.mean(), 20 * np.log10(255 / np.sqrt(((a - b) ** 2).mean()))))
    tiled = measure.compare_tiled(x, y, ["y", "x"], 255.0, 4, 4).first()
    assert tuple(tiled) == pytest.approx(tuple(got))  # even tiles
    assert measure.compare(x, x, ["y", "x"], 255.0).first()["psnr"] is None


def test_render(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 255, (3, 5, 4))
    channels = [(0, 0.0, 255.0, 1.0, 0.0, 0.0, 1.0), (1, 20.0, 200.0, 0.0, 1.0, 0.5, 0.5), (2, 0.0, 255.0, 0.2, 0.2, 1.0, 0.0)]
    df = spark.createDataFrame(channels, "c long, low double, high double, red double, green double, blue double, alpha double")
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in compose.render(px(spark, a, "cyx"), df).collect()}
    out, total = np.zeros((5, 4, 3)), 0
    for c, low, high, *rgb, alpha in channels:
        alpha = alpha or 1.0
        out += np.clip((a[c] - low) / (high - low), 0, 1)[:, :, None] * np.array(rgb) * alpha
        total += alpha
    want = np.floor(out / total * 255 + 1e-9).astype(int)
    assert all(got[k] == tuple(want[k]) for k in np.ndindex(5, 4))


def test_channels(spark):
    a = px(spark, np.ones((2, 2, 2)), "cyx")
    assert sorted(r["c"] for r in compose.combine([(a, 2), (a, 2)]).select("c").distinct().collect()) == [0, 1, 2, 3]
    sources = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "k long, n long")
    assert [r["offset"] for r in compose.channel_offsets(sources, "k", "n").orderBy("k").collect()] == [0, 3, 4]
    one = spark.createDataFrame([(0, "g", [1.0, 1.0, 1.0, 1.0])], "c long, label string, color array<double>")
    assert [r["label"] for r in compose.rgb_labels(one, 3).orderBy("c").collect()] == ["Red", "Green", "Blue"]
    assert [r["label"] for r in compose.rgb_labels(one, 1).collect()] == ["g"]
    labels = spark.createDataFrame([("RGB", "t", 1, 3), ("DAPI", "t", 0, 3), (None, "t", 0, 1)], "l string, t string, c long, n long")
    assert [r[0] for r in labels.select(compose.channel_label(F.col("l"), F.col("t"), F.col("c"), F.col("n"))).collect()] == ["t#1", "DAPI", "t"]


def test_flatfield(spark):
    rng = np.random.default_rng(3)
    tiles, dark, bright = rng.random((4, 5, 6)), rng.random((5, 6)) * 0.1, 0.5 + rng.random((5, 6)) * 0.5
    want = np.clip((tiles - dark) * (bright - dark).mean() / (bright - dark), 0, 1)
    got = compose.flatfield(px(spark, tiles, ("tile", "y", "x")), px(spark, dark), px(spark, bright))
    assert np.allclose(array(got, tiles.shape, ("tile", "y", "x")), want)


def test_collections(spark):
    images = spark.createDataFrame([(1, 1, 1, "Alpha"), (1, 1, 2, "beta"), (1, 2, 3, "ALPHA two"), (2, 3, 4, "gamma"), (2, 3, 4, "gamma")], "project_id long, dataset_id long, image_id long, name string")
    ids = lambda *a: sorted(r["image_id"] for r in collection.select_images(images, *a).collect())
    assert ids({"project": [1], "image": [4]}, {}) == [1, 2, 3, 4]
    assert ids({"project": [1, 2]}, {"dataset": [1]}) == [3, 4]
    assert ids({"project": [1]}, {}, ["alp"], ["two$"]) == [1]
    assert ids({}, {}) == []
    notes = spark.createDataFrame([(1, "Kind", "a", 1), (1, "kind", "b", 2), (1, "Other", "z", 3), (2, "nope", "q", 1)], "image_id long, name string, value string, ord long")
    table = collection.label_table(images, notes, ["KIND", "other"], "ord", "tif").collect()
    assert [(r["image_id"], r["KIND"], r["other"], r["path"]) for r in table] == [(1, "b", "z", "Alpha.tif")]
    assert {r["name"]: r["n"] for r in collection.label_counts(notes, "name").collect()} == {"Kind": 1, "kind": 1, "Other": 1, "nope": 1}


def test_pairing(spark):
    lists = spark.createDataFrame([("a", "2"), ("a", "1"), ("a", "3"), ("b", "y"), ("b", "x")], "g string, n string")
    assert [(r["k"], r["names"]) for r in collection.zip_lists(lists, "g", "n").orderBy("k").collect()] == [(1, ["1", "x"]), (2, ["2", "y"])]
    files = spark.createDataFrame([("tile_01.tif",), ("tile_1.tif",), ("other",)], "file string")
    layout = spark.createDataFrame([("tile_0",), ("1.t",), ("",)], "title string")
    got = {(r["file"], r["title"]) for r in collection.match_layout(files, layout).collect()}
    assert got == {("tile_01.tif", "tile_0"), ("tile_01.tif", "1.t"), ("tile_1.tif", "1.t")}


def test_space(spark):
    rng = np.random.default_rng(4)
    p = rng.random((80, 3)) * [100, 100, 10] - [50, 50, 0]
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double, r double")
    got = {(r["a"], r["b"]) for r in collection.neighbours(points, 12.0).collect()}
    want = {(a, b) for a in range(80) for b in range(80) if 0 < np.hypot(*(p[a, :2] - p[b, :2])) < 12 and p[b, 2] < p[a, 2]}
    assert got == want
    edges = measure.layout_edges(spark.createDataFrame([(x, y) for x in range(3) for y in range(4)], "sx long, sy long"))
    assert sorted((r["sx"], r["sy"]) for r in edges.collect()) == [(1, 1), (1, 2)]


def test_neighbours_of_crowded_cells(spark, tmp_path, monkeypatch):
    """Points are never broadcast, however small their files; cells in pieces and odd coordinates lose no pair."""
    rng = np.random.default_rng(6)
    p = np.vstack([rng.random((120, 3)) * [60, 60, 5], np.round(rng.random((60, 3)) * [40, 40, 4]), np.full((20, 3), 5.0)])
    odd = [(900, float("nan"), 1.0, 1.0), (901, float("inf"), 1.0, 2.0), (902, float("inf"), 2.0, 3.0), (903, 1e300, 1.0, 1.0), (904, 1e300, 2.0, 2.0), (905, None, 1.0, 1.0), (906, 5.0, 6.0, None)]
    spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)] + odd, "id long, x double, y double, r double").write.parquet(str(tmp_path / "points"))
    want = {(a, b) for a in range(200) for b in range(200) if 0 < ((p[a, :2] - p[b, :2]) ** 2).sum() < 144 and p[b, 2] < p[a, 2]} | {(904, 903)}
    for crowd in (4096, 7):
        monkeypatch.setattr(collection, "CROWD", crowd, raising=False)
        found = collection.neighbours(spark.read.parquet(str(tmp_path / "points")), 12.0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2  # the two with counts of crowded cells
        got = [(r["a"], r["b"]) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want


def test_pixels_are_never_broadcast(spark, tmp_path):
    """A small file of arrays holds many pixels: only rows of channels are broadcast, and no task sums pixels before they are
    dealt out."""
    a = np.arange(7 * 6).reshape(7, 6) * 5.0
    spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(a)], "y long, v array<double>").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).select("y", F.posexplode("v").alias("x", "v"))
    image = rows.select((F.col("x") % 2).cast("long").alias("c"), "y", F.floor(F.col("x") / 2).alias("x"), "v")
    channels = spark.createDataFrame([(0, 0.0, 100.0, 1.0, 0.0, 0.5, 1.0), (1, 50.0, 250.0, 0.0, 1.0, 0.25, 0.0)], "c long, low double, high double, red double, green double, blue double, alpha double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sent = lambda df: [x.split("+- Exchange")[0] for x in plan(df).split("BroadcastExchange")[1:]]
    found = compose.render(image, channels)
    assert not any("posexplode" in x for x in sent(found))
    assert "Aggregate" not in plan(found).split("REPARTITION")[1].split("BroadcastExchange")[0]
    low, high = np.clip(a[:, ::2] / 100, 0, 1), np.clip((a[:, 1::2] - 50) / 200, 0, 1)
    want = {(y, x): tuple(int(np.floor(k / 2 * 255 + 1e-9)) for k in (low[y, x], high[y, x], low[y, x] * 0.5 + high[y, x] * 0.25)) for y in range(7) for x in range(3)}
    assert {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in found.collect()} == want
    assert [tuple(r) for r in compose.render(image.where("y = 0 and x = 1").select("c", "v"), channels).collect()] == [want[0, 1]]
    assert "BroadcastHashJoin" not in plan(measure.distances(image, image, ["y", "x"]))
    field = image.where("c = 0").select("y", "x", (F.col("v") / 255).alias("v"))
    assert "ShuffledHashJoin" in plan(compose.flatfield(image, field, field))
