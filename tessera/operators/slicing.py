"""Regions, axes and tiles of pixel tables.

A pixel table has the columns t, c, z, y, x (longs) and v; a missing row means 0. Every operator here is a filter, a
projection or one aggregation by integer keys, so regions reach the scan and tiles are equi-keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("t", "c", "z", "y", "x")


def slice_region(px: DataFrame, **bounds) -> DataFrame:
    """axis=(start, end): half-open, a negative end is open; axis=k: that index only, and the axis goes."""
    for axis, b in bounds.items():
        if isinstance(b, tuple):
            start, end = b
            if start:
                px = px.where(F.col(axis) >= start)
            if end is not None and end >= 0:
                px = px.where(F.col(axis) < end)
        elif b is not None:
            px = px.where(F.col(axis) == b).drop(axis)
    return px


def scale_bounds(factor: float, **bounds) -> dict:
    """x and y bounds of one resolution in pixels of another, half-even; other axes stay."""
    return {a: tuple(round(v / factor) if v is not None and v >= 0 else v for v in b) if a in "xy" and isinstance(b, tuple) else b for a, b in bounds.items()}


def slice_micrometers(px: DataFrame, pixel_size: dict[str, float], **bounds) -> DataFrame:
    return slice_region(px, **{a: tuple(round(v / pixel_size[a]) for v in b) for a, b in bounds.items()})


def scale_slicing(scale: float, **bounds) -> dict:
    """The x and y bounds of a region in a level of another scale, truncated; other axes stay."""
    return {a: tuple(int(v * scale) for v in b) if a in "xy" and isinstance(b, tuple) else b for a, b in bounds.items()}


def chunk_shape(tile: int | tuple[int, int], dimensions: int) -> tuple[int, ...]:
    """A tile size (one number for squares, or width and height) as the chunk of an array with y and x last."""
    width, height = (tile, tile) if isinstance(tile, int) else tile
    return (1,) * (dimensions - 2) + (height, width)


def patches(sizes: DataFrame, n: int, height: int, width: int, seed: int = 0) -> DataFrame:
    """n patches at random places of each image (image_id, size_y, size_x): k, y0, x0. The places come from a digest, so they
    are the same in every run and need no shuffle."""
    rows = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = lambda axis, room: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col("image_id").cast("string"), F.col("k").cast("string"))), 1, 12), 16, 10).cast("long"), F.greatest(room, F.lit(1)).cast("long"))
    return rows.select("image_id", "k", draw("y", F.col("size_y") - height + 1).alias("y0"), draw("x", F.col("size_x") - width + 1).alias("x0"))


def redimension(px: DataFrame, order: str, **index) -> DataFrame:
    """The axes of `order`: one that goes keeps an index (0 if not given), one that comes is 0."""
    for axis in AXES:
        if axis in px.columns and axis not in order:
            px = px.where(F.col(axis) == index.get(axis, 0)).drop(axis)
        elif axis not in px.columns and axis in order:
            px = px.withColumn(axis, F.lit(0).cast("long"))
    return px.select(*order, "v")


def reorder(items: list, old: str, new: str, default=0) -> list:
    return [items[old.index(a)] if a in old else default for a in new]


def tiles(px: DataFrame, height: int, width: int) -> DataFrame:
    """ty, tx: the tile that a pixel falls into."""
    return px.withColumn("ty", F.floor(F.col("y") / height)).withColumn("tx", F.floor(F.col("x") / width))


def tile_stats(px: DataFrame, height: int, width: int, *by: str) -> DataFrame:
    return tiles(px, height, width).groupBy(*by, "ty", "tx").agg(F.count("*").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"))


def tile_grid(sizes: DataFrame, height: int, width: int) -> DataFrame:
    """One row for each tile of each image (image_id, size_y, size_x): ty, tx, y0, x0, h, w, clipped at the edges."""
    count = lambda size, step: F.ceil(F.col(size) / step).cast("long")
    grid = sizes.where("size_y > 0 and size_x > 0").withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), count("size_y", height) - 1)))
    grid = grid.withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), count("size_x", width) - 1)))
    grid = grid.withColumn("y0", F.col("ty") * height).withColumn("x0", F.col("tx") * width)
    return grid.withColumn("h", F.least(F.lit(height), F.col("size_y") - F.col("y0"))).withColumn("w", F.least(F.lit(width), F.col("size_x") - F.col("x0")))


def _dense(p: Column, h: Column, w: Column) -> Column:
    """Values in row order of sorted pixels (y, x, v) of an h x w tile; pixels that aren't there are 0. Linear in the tile:
    a gap before a pixel is filled with as many zeros."""
    at = lambda s: (s["y"] * w + s["x"]).cast("int")
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(at(F.get(p, i - 1)))
    filled = F.flatten(F.transform(p, lambda s, i: F.concat(F.array_repeat(F.lit(0.0), at(s) - before(i) - 1), F.array(s["v"]))))
    rest = F.array_repeat(F.lit(0.0), (h * w).cast("int") - 1 - at(F.element_at(p, -1)))
    return F.when(F.size(p) == h * w, F.transform(p, lambda s: s["v"])).otherwise(F.concat(filled, rest))


def pack(px: DataFrame, height: int, width: int, *by: str) -> DataFrame:
    """Tiles as arrays in row order: ty, tx, h, w, data; pixels without a row are 0."""
    at = F.struct((F.col("y") % height).alias("y"), (F.col("x") % width).alias("x"), F.col("v").cast("double").alias("v"))
    rows = tiles(px, height, width).groupBy(*by, "ty", "tx").agg(F.sort_array(F.collect_list(at)).alias("_p"), (F.max(F.col("y") % height) + 1).alias("h"), (F.max(F.col("x") % width) + 1).alias("w"))
    return rows.withColumn("data", _dense(F.col("_p"), F.col("h"), F.col("w"))).drop("_p")


def unpack(chunks: DataFrame, height: int, width: int, *by: str) -> DataFrame:
    rows = chunks.select(*by, "ty", "tx", "w", F.posexplode("data").alias("k", "v"))
    return rows.select(*by, (F.col("ty") * height + F.floor(F.col("k") / F.col("w"))).alias("y"), (F.col("tx") * width + F.col("k") % F.col("w")).alias("x"), "v")


def covering(chunks: DataFrame, height: int, width: int, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Only tiles that a region touches: comparisons on the integer keys, which prune files and row groups."""
    return chunks.where(F.col("ty").between(y0 // height, (y1 - 1) // height) & F.col("tx").between(x0 // width, (x1 - 1) // width))


def full_grid(spark, sizes: dict[str, int]) -> DataFrame:
    """Every coordinate of the axes in sizes."""
    total = 1
    for n in sizes.values():
        total *= n
    out, step = spark.range(total), total
    for axis, n in sizes.items():
        step //= n
        out = out.withColumn(axis, F.floor(F.col("id") / step) % n)
    return out.drop("id")


def fill(px: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """All coordinates; pixels without a row are 0."""
    keys = list(sizes)
    return full_grid(px.sparkSession, sizes).join(px, keys, "left").withColumn("v", F.coalesce("v", F.lit(0)))


def reshape(px: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Cropped to the new size, or padded with the last row and column."""
    other = [c for c in px.columns if c not in ("y", "x", "v")]
    inside = px.where((F.col("y") < new_height) & (F.col("x") < new_width))
    last = lambda c, old, new: F.when(F.col(c) == old - 1, F.sequence(F.lit(old - 1).cast("long"), F.lit(max(old, new) - 1).cast("long"))).otherwise(F.array(F.col(c)))
    out = inside.withColumn("y", F.explode(last("y", height, new_height))).withColumn("x", F.explode(last("x", width, new_width)))
    return out.where((F.col("y") < new_height) & (F.col("x") < new_width)).select(*other, "y", "x", "v")


def shape(px: DataFrame, axes: str = "tczyx") -> DataFrame:
    return px.agg(*[(F.max(a) + 1).alias(f"size_{a}") for a in axes])
