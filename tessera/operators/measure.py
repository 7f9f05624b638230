"""Aggregates over pixels: quantiles, windows, statistics over tiles, comparison of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(px: DataFrame, q: list[float], *by: str) -> DataFrame:
    """Exact, linear between neighbours; one column for each quantile. For groups of few values, such as the tiles at a
    pixel: a task holds all distinct values of a group. channel_quantiles() has no such bound."""
    found = px.groupBy(*by).agg(F.percentile(F.col("v").cast("double"), F.array(*[F.lit(x) for x in q])).alias("q"))
    return found.select(*by, *[F.col("q")[k].alias(f"q{k}") for k in range(len(q))])


def channel_quantiles(px: DataFrame, q: list[float], *by: str, bins: int = 4096) -> DataFrame:
    """The same for few groups of any size: a histogram finds the bins that hold the ranks asked for, then only the values in
    these bins are counted and ordered. By no columns the whole is one group."""
    by = by or ("_all",)
    rows = px.where(F.col("v").isNotNull()).select(*[F.lit(0).alias(c) if c == "_all" else F.col(c) for c in by], F.col("v").cast("double").alias("v"))
    stats = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    bin_of = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    # a row for each group: groups are channels
    binned = rows.join(F.broadcast(stats), list(by)).select(*by, "v", "n", bin_of.alias("bin"))
    hist = binned.groupBy(*by, "n", "bin").agg(F.count("*").alias("m"))
    hist = hist.withColumn("before", F.sum("m").over(Window.partitionBy(*by).orderBy("bin")) - F.col("m"))
    place = lambda x: F.lit(float(x)) * (F.col("n") - 1)
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.least(F.floor(place(x)) + side, F.col("n") - 1).alias("rank"), (place(x) - F.floor(place(x))).alias("part")) for k, x in enumerate(q) for side in (0, 1)])
    wanted = hist.withColumn("r", F.explode(ranks)).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("m")))
    wanted = wanted.select(*by, "bin", "r.k", "r.side", (F.col("r.rank") - F.col("before")).alias("rank"), "r.part")
    inside = binned.join(F.broadcast(wanted.select(*by, "bin").distinct()), [*by, "bin"]).groupBy(*by, "bin", "v").agg(F.count("*").alias("m"))
    inside = inside.withColumn("before", F.sum("m").over(Window.partitionBy(*by, "bin").orderBy("v")) - F.col("m"))
    found = inside.join(F.broadcast(wanted), [*by, "bin"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    value = lambda k: F.sum(F.when(F.col("k") == k, F.when(F.col("side") == 0, F.col("v") * (1 - F.col("part"))).otherwise(F.col("v") * F.col("part"))))
    out = found.groupBy(*by).agg(*[value(k).alias(f"q{k}") for k in range(len(q))])
    return out.drop("_all")


def approximate_quantiles(px: DataFrame, q: list[float], *by: str, accuracy: int = 10_000) -> DataFrame:
    """Sketches of fixed size instead of all distinct values: for images that have no small level."""
    found = px.groupBy(*by).agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in q]), F.lit(accuracy)).alias("q"))
    return found.select(*by, *[F.col("q")[k].alias(f"q{k}") for k in range(len(q))])


def channel_windows(pyramid: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """c, q0, q1 from the smallest level only."""
    last = pyramid.agg(F.max("level").alias("last"))
    return channel_quantiles(pyramid.join(F.broadcast(last), F.col("level") == F.col("last")), [low, high], "c")


def display_windows(pyramid: DataFrame, channels: DataFrame, dtype: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """c, start, end, min, max. channels: c, min, max (null: none given). A window that is given stays. Else one-byte images
    and those of one level show their whole range, others quantiles of the smallest level."""
    start, end = (0.0, 1.0) if dtype.startswith("float") else (0.0, float(2 ** int(dtype[4:]) - 1)) if dtype.startswith("u") else (-float(2 ** (int(dtype[3:]) - 1)), float(2 ** (int(dtype[3:]) - 1) - 1))
    found = channel_windows(pyramid, low, high)
    whole = F.lit(dtype == "uint8") | (F.col("levels") < 2)
    rows = channels.join(found, "c", "left").join(F.broadcast(pyramid.agg(F.countDistinct("level").alias("levels"))), F.lit(True))
    pick = lambda given, q, bound: F.coalesce(F.col(given), F.when(whole, F.lit(bound)).otherwise(F.col(q)), F.lit(bound)).alias(given)
    return rows.select("c", F.lit(start).alias("start"), F.lit(end).alias("end"), pick("min", "q0", start), pick("max", "q1", end))


def tiles_median(px: DataFrame) -> DataFrame:
    """Median over all tiles at each pixel."""
    return px.groupBy("c", "y", "x").agg(F.median("v").alias("v"))


def tiles_quantiles(px: DataFrame, q: list[float], top: float) -> DataFrame:
    found = px.groupBy("c", "y", "x").agg(F.percentile(F.col("v").cast("double"), F.array(*[F.lit(x) for x in q])).alias("q"))
    return found.select("c", "y", "x", F.posexplode("q").alias("k", "v")).withColumn("v", F.col("v") / top)


def signal_filter(px: DataFrame, median: DataFrame, tile: str = "tile") -> DataFrame:
    """Tiles whose mean distance from the median image is below the mean of these means."""
    means = px.join(median.select("c", "y", "x", F.col("v").alias("m")), ["c", "y", "x"]).groupBy(tile).agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("signal"))
    return means.join(F.broadcast(means.agg(F.avg("signal").alias("threshold"))), F.col("signal") < F.col("threshold")).drop("threshold")


def distances(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """d at each pixel: the length of the difference over all channels."""
    # sorted, never broadcast: Spark sees the size of files, not of pixels
    both = a.join(b.select(*keys, "c", F.col("v").alias("w")).hint("merge"), [*keys, "c"])
    return both.groupBy(*keys).agg(F.sqrt(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))).alias("d"), F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("sq"), F.count("*").alias("n"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], top: float) -> DataFrame:
    """dif_max, dif_mean, psnr of two images; psnr is null for equal ones."""
    rms = F.sqrt(F.sum("sq") / F.sum("n"))
    return distances(a, b, keys).agg(F.max("d").alias("dif_max"), F.avg("d").alias("dif_mean"), F.when(rms > 0, 20 * F.log10(top / F.when(rms > 0, rms))).alias("psnr"))


def compare_tiled(a: DataFrame, b: DataFrame, keys: list[str], top: float, height: int, width: int) -> DataFrame:
    """The same tile by tile: maximum of maxima, mean of means, psnr from the mean of mean squares."""
    d = distances(a, b, keys).withColumn("ty", F.floor(F.col("y") / height)).withColumn("tx", F.floor(F.col("x") / width))
    tile = d.groupBy("ty", "tx").agg(F.max("d").alias("m"), F.avg("d").alias("a"), (F.sum("sq") / F.sum("n")).alias("s"))
    mse = F.avg("s")
    return tile.agg(F.max("m").alias("dif_max"), F.avg("a").alias("dif_mean"), F.when(mse > 0, 20 * F.log10(top / F.sqrt(F.when(mse > 0, mse)))).alias("psnr"))


def used_fraction(px: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of one-byte values between the two thresholds, both included."""
    return px.agg(F.avg(F.when(F.col("v").between(round(threshold * 255), round((1 - threshold) * 255)), 1.0).otherwise(0.0)).alias("used"))


def layout_edges(tiles: DataFrame) -> DataFrame:
    """Tiles (with sx, sy) that lie on no edge of the layout."""
    edge = tiles.agg(F.min("sx").alias("x0"), F.max("sx").alias("x1"), F.min("sy").alias("y0"), F.max("sy").alias("y1"))
    return tiles.join(F.broadcast(edge), (F.col("sx") > F.col("x0")) & (F.col("sx") < F.col("x1")) & (F.col("sy") > F.col("y0")) & (F.col("sy") < F.col("y1"))).drop("x0", "x1", "y0", "y1")


def uncompressed_bytes(levels: DataFrame, *by: str) -> DataFrame:
    """Over all levels: bytes of a sample times all sizes."""
    n = F.col("nbits").cast("long")
    for a in "xyzct":
        n = n * F.col(f"size_{a}")
    return levels.groupBy(*by).agg(F.sum(F.floor(n / 8)).alias("n_bytes"))


def needs_bigtiff(levels: DataFrame, *by: str) -> DataFrame:
    return uncompressed_bytes(levels, *by).withColumn("big", F.col("n_bytes") > 1 << 32)


def image_info(levels: DataFrame, *by: str) -> DataFrame:
    """A line of text for each image: the sizes of its levels, and the bytes that they take uncompressed."""
    sizes = F.struct("level", F.concat_ws(" ", *[f"size_{a}" for a in "xyzct"]).alias("s"))
    text = levels.groupBy(*by).agg(F.sort_array(F.collect_list(sizes)).alias("l"))
    rows = text.join(uncompressed_bytes(levels, *by), list(by))
    return rows.select(*by, F.concat(F.lit("XYZCT: "), F.array_join(F.transform("l", lambda s: s["s"]), ", "), F.lit(" Uncompressed: "), F.col("n_bytes").cast("string")).alias("info"))


def normalisation_images(px: DataFrame, q: list[float], top: float) -> DataFrame:
    """c, y, x, k, v: quantile images (0 to 1) over the tiles with little signal, which show the field and not the sample.

    Tiles whose distance from the median image is below the mean one are kept; px: tile, c, y, x, v."""
    quiet = signal_filter(px, tiles_median(px)).select("tile")
    return tiles_quantiles(px.join(quiet, "tile", "left_semi"), q, top)
