"""Resampling: block means and maxima, area and cubic resizing, blurring, pyramids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _others(px: DataFrame) -> list[str]:
    return [c for c in px.columns if c not in ("y", "x", "v")]


def _block(px: DataFrame, fy: int, fx: int, value: Column) -> DataFrame:
    rows = px.withColumn("y", F.floor(F.col("y") / fy)).withColumn("x", F.floor(F.col("x") / fx))
    return rows.groupBy(*_others(px), "y", "x").agg(value.alias("v"))


def block_mean(px: DataFrame, fy: int, fx: int) -> DataFrame:
    return _block(px, fy, fx, F.avg("v"))


def block_max(px: DataFrame, fy: int, fx: int) -> DataFrame:
    return _block(px, fy, fx, F.max("v"))


def block_mean_zero_padded(px: DataFrame, fy: int, fx: int) -> DataFrame:
    """Blocks at the edge are filled up with zeros."""
    return _block(px, fy, fx, F.sum("v") / float(fy * fx))


def stride(px: DataFrame, fy: int, fx: int) -> DataFrame:
    """Nearest neighbour by whole factors."""
    kept = px.where((F.col("y") % fy == 0) & (F.col("x") % fx == 0))
    return kept.withColumn("y", F.floor(F.col("y") / fy)).withColumn("x", F.floor(F.col("x") / fx))


#: Rows of a table of taps (24 bytes each) that is broadcast; a longer one is joined.
MOST_TAPS = 1 << 20


def _tapped(px: DataFrame, axis: str, taps: DataFrame, rows: int, mean: bool) -> DataFrame:
    """taps: i, o, w: how much of the old pixel i goes into the new one o. The table grows with one axis only."""
    keys = [c for c in px.columns if c not in (axis, "v")]
    taps = F.broadcast(taps) if rows <= MOST_TAPS else taps
    value = F.sum(F.col("v") * F.col("w"))
    joined = px.join(taps, F.col(axis) == F.col("i")).select(*keys, "v", "w", F.col("o").alias(axis))
    return joined.groupBy(*keys, axis).agg((value / F.sum("w") if mean else value).alias("v")).select(*px.columns)


def area_resize(px: DataFrame, axis: str, old: int, new: int) -> DataFrame:
    """Means over the old pixels that a new one covers, by overlap."""
    s = old / new
    i, o = F.col("i"), F.col("o")
    first, last = F.floor(i / s), F.least(F.ceil((i + 1) / s) - 1, F.lit(new - 1))
    taps = px.sparkSession.range(old).select(F.col("id").alias("i")).withColumn("o", F.explode(F.sequence(first, last)))
    taps = taps.withColumn("w", F.least(i + 1.0, (o + 1) * s) - F.greatest(i * 1.0, o * s)).where("w > 1e-12")
    return _tapped(px, axis, taps, old + new, True)


def _cubic(d: Column, a: float = -0.75) -> Column:
    d = F.abs(d)
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def cubic_resize(px: DataFrame, axis: str, old: int, new: int, a: float = -0.75) -> DataFrame:
    """Four taps around each new pixel's centre; beyond the border the last pixel goes on."""
    centre = (F.col("o") + 0.5) * (old / new) - 0.5
    taps = px.sparkSession.range(new).select(F.col("id").alias("o"), F.explode(F.sequence(F.lit(-1), F.lit(2))).alias("k")).withColumn("j", F.floor(centre) + F.col("k"))
    taps = taps.withColumn("w", _cubic(centre - F.col("j"), a)).withColumn("i", F.least(F.greatest(F.col("j"), F.lit(0)), F.lit(old - 1)))
    return _tapped(px, axis, taps.groupBy("i", "o").agg(F.sum("w").alias("w")).where("w <> 0"), 4 * new, True)


def resize(px: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Cubic if the image grows on average, else by area; 1 pixel at least."""
    new_height, new_width = max(new_height, 1), max(new_width, 1)
    one = cubic_resize if (height / new_height + width / new_width) / 2 < 1 else area_resize
    out = one(px, "x", width, new_width) if width != new_width else px
    return one(out, "y", height, new_height) if height != new_height else out


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights from -radius to radius."""
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def blur(px: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian blur along y and x; beyond the border pixels are mirrored, the last one repeated."""
    weights = gaussian(sigma)
    r = len(weights) // 2
    kernel = F.array(*[F.lit(w) for w in weights])
    for axis, n in (("x", width), ("y", height)):
        taps = px.sparkSession.range(n).select(F.col("id").alias("o"), F.posexplode(kernel).alias("d", "w"))
        at = F.pmod(F.col("o") + F.col("d") - r, F.lit(2 * n))
        taps = taps.withColumn("i", F.when(at < n, at).otherwise(2 * n - 1 - at)).groupBy("i", "o").agg(F.sum("w").alias("w"))
        px = _tapped(px, axis, taps, n * len(weights), False)
    return px


def pyramid(px: DataFrame, levels: int, downsample: int = 2, nearest: bool = False) -> DataFrame:
    """All levels, level 0 first. Means go from level to level; nearest picks from the base."""
    out, at = px.withColumn("level", F.lit(0)), px
    for k in range(1, levels + 1):
        at = stride(px, downsample**k, downsample**k) if nearest else block_mean(at, downsample, downsample)
        out = out.unionByName(at.withColumn("level", F.lit(k)))
    return out


def pyramid_sizes(sizes: DataFrame, levels: int, downsample: float, columns: tuple[str, ...] = ("size_x", "size_y"), truncate: bool = False, volumetric: bool = False) -> DataFrame:
    """One row for each level 1 to levels: half-even rounding and 1 at least, or truncation. volumetric: size_z shrinks, too,
    where there are several planes."""
    rows = sizes.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    scaled = lambda c: F.col(c) / F.pow(F.lit(float(downsample)), F.col("level"))
    for c in (*columns, "size_z") if volumetric else columns:
        size = scaled(c).cast("long") if truncate else F.greatest(F.rint(scaled(c)).cast("long"), F.lit(1).cast("long"))
        rows = rows.withColumn(c, F.when(F.col(c) > 1, size).otherwise(F.col(c)) if c == "size_z" else size)
    return rows
