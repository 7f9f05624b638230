"""Channels: rendering, combining, flat-field correction, pasting tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels

#: Labels that only name a photometric interpretation.
PHOTOMETRIC = ("", "minisblack", "miniswhite", "rgb", "palette", "ycbcr", "cielab")
RGB = (("Red", (1.0, 0.0, 0.0, 1.0)), ("Green", (0.0, 1.0, 0.0, 1.0)), ("Blue", (0.0, 0.0, 1.0, 1.0)))


def render_rgb(px: DataFrame, dtype: str, low: float = 0.0, high: float | None = None) -> DataFrame:
    """An image whose channels are red, green and blue: unchanged, two-byte values windowed to the whole range."""
    if pixels.nbytes(dtype) != 2:
        return px
    top = pixels.type_max(dtype)
    return px.withColumn("v", (pixels.normalise(F.col("v"), low, high if high is not None else top) * top).cast("int"))


def _dealt(px: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by keys. Up to a number of partitions Spark writes rows straight into a file for each; beyond, it gathers and
    sorts all that a task sends, so there are no more than that."""
    if not keys:
        return px
    conf = px.sparkSession.conf
    direct = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return px.repartition(*keys) if int(conf.get("spark.sql.shuffle.partitions")) <= direct else px.repartition(max(direct, 1), *keys)


def render(px: DataFrame, channels: DataFrame, top: int = 255) -> DataFrame:
    """y, x, r, g, b: channels (c, low, high, red, green, blue, alpha) blended by colour and alpha. Values are windowed
    first; alpha 0 counts as 1; the sum goes by the sum of the alphas, then truncates. Pixels are dealt out before they are
    summed: the task that reads them would hold them all in its partial sums, which shrink little."""
    a = F.when(F.col("alpha") == 0, 1.0).otherwise(F.col("alpha"))
    share = pixels.normalise(F.col("v"), F.col("low"), F.col("high")) * a
    total = channels.agg(F.sum(a).alias("total"))  # one row
    keys = [k for k in px.columns if k not in ("c", "v")]
    # a row for each channel is broadcast, never the pixels
    rows = _dealt(px, keys).join(F.broadcast(channels.crossJoin(total)), "c")
    mixed = lambda name: (F.sum(share * F.col(name)) / F.max("total") * top)
    # the last digits of a sum depend on its order: a hair is added before it is cut
    return rows.groupBy(*keys).agg(*[F.floor(mixed(n) + 1e-9).cast("int").alias(o) for n, o in (("red", "r"), ("green", "g"), ("blue", "b"))])


def combine(images: list[tuple[DataFrame, int]]) -> DataFrame:
    """Images one after another along the channel axis; each comes with its number of channels."""
    out, offset = None, 0
    for px, n in images:
        moved = px.withColumn("c", F.col("c") + offset)
        out, offset = moved if out is None else out.unionByName(moved), offset + n
    return out


def channel_offsets(sources: DataFrame, order: str, n: str) -> DataFrame:
    """The same from a catalog: by how much each source's channels move. One row per source goes through the window."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sources.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def channel_label(label: Column, title: Column, c: Column, n: Column) -> Column:
    """A telling label stays; else the file's title, numbered if the source has several channels."""
    return F.when(~F.lower(F.coalesce(label, F.lit(""))).isin(*PHOTOMETRIC), label).otherwise(F.when(n > 1, F.concat(title, F.lit("#"), c.cast("string"))).otherwise(title))


def rgb_labels(channels: DataFrame, samples: int) -> DataFrame:
    """Red, green and blue where an image of three samples has fewer channel records."""
    if samples != 3:
        return channels
    spark = channels.sparkSession
    default = spark.createDataFrame([(k, n, list(c)) for k, (n, c) in enumerate(RGB)], "c long, label string, color array<double>")
    return default.join(channels.agg(F.count("*").alias("n")).where("n < 3"), F.lit(True)).drop("n").unionByName(channels.select("c", "label", "color").join(channels.agg(F.count("*").alias("n")).where("n >= 3"), F.lit(True)).drop("n"))


def flatfield(px: DataFrame, dark: DataFrame, bright: DataFrame) -> DataFrame:
    """Tiles corrected by a dark and a bright image of one tile's size (y, x, v), values from 0 to 1."""
    field = dark.select("y", "x", F.col("v").alias("d")).join(bright.select("y", "x", F.col("v").alias("b")), ["y", "x"])
    mean = field.agg(F.avg(F.col("b") - F.col("d")).alias("mean"))
    # tasks hold the field, never the pixels, which Spark would broadcast where their files are small
    rows = px.join(field.hint("shuffle_hash"), ["y", "x"]).join(F.broadcast(mean), F.lit(True))
    return rows.withColumn("v", pixels.flatfield(F.col("v"), F.col("d"), F.col("b"), F.col("mean"))).drop("d", "b", "mean")


def paste(px: DataFrame, order: str, *keys: str) -> DataFrame:
    """Tiles on a canvas: where they overlap the last one by `order` stays."""
    return px.groupBy(*keys).agg(F.max_by("v", order).alias("v"))


def split_channels(px: DataFrame, n: int) -> list[DataFrame]:
    """One image for each of n channels, without the channel axis; combine() puts them together again."""
    return [px.where(F.col("c") == k).drop("c") for k in range(n)]


def merge_channels(images: list[DataFrame]) -> DataFrame:
    return combine([(px.withColumn("c", F.lit(0).cast("long")), 1) for px in images])


def correct(px: DataFrame, dark: DataFrame, bright: DataFrame, dtype: str) -> DataFrame:
    """Flat-field correction of an integer image: to 0 to 1, corrected by quantile images (y, x, v from 0 to 1), and back."""
    found = flatfield(px.withColumn("v", pixels.int_to_float(F.col("v"), dtype)), dark, bright)
    # a hair is added before the value is cut: it is off in its last digits
    return found.withColumn("v", F.floor(F.col("v") * float(pixels.type_max(dtype)) + 1e-9).cast("long"))


def stretch(px: DataFrame, windows: DataFrame, *by: str) -> DataFrame:
    """Values from 0 to 1 between each group's low and high quantile (q0, q1)."""
    rows = px.join(F.broadcast(windows), list(by)) if by else px.join(F.broadcast(windows), F.lit(True))
    return rows.withColumn("v", pixels.normalise(F.col("v"), F.col("q0"), F.col("q1"))).drop("q0", "q1")
