"""Synthetic images: a sine along one axis in each channel, with noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators.slicing import full_grid


def generate(spark: SparkSession, size: dict[str, int], dtype: str = "uint8", seed: int = 0, noise: float = 1.0, channels: int = 3) -> DataFrame:
    """z, y, x, c, v: channel k follows the k-th of the axes x, y, z that the image has, the last one goes on; noise of the
    given width is added and the sum clipped."""
    axes = [a for a in "xyz" if size.get(a, 1) > 1] or ["x"]
    full = {"z": size.get("z", 1), "y": size.get("y", 1), "x": size.get("x", 1), "c": channels}
    px = full_grid(spark, full)
    value = F.lit(0.0)
    for k in range(channels):
        a = axes[min(k, len(axes) - 1)]
        value = F.when(F.col("c") == k, F.sin(math.pi * F.col(a) / size[a])).otherwise(value)
    if noise:
        value = value + (F.rand(seed) - 0.5) * noise
    top = pixels.type_max(dtype)
    # a hair against sines that end in ...999
    return px.withColumn("v", (F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * top + 1e-9).cast("int" if pixels.nbytes(dtype) < 4 else "long"))
