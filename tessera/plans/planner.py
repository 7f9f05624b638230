"""Choosing a resolution: which level to read and how far to resize it, from the catalog of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_level(levels: DataFrame, target: str = "target") -> DataFrame:
    """levels: image_id, level, size_x, size_y and the target's size in level 0 pixels (a pixel size over the wanted one).

    The last level that still holds more pixels than wanted, or as many; level 0 if none does. level, factor: what is left
    to resize by."""
    first = Window.partitionBy("image_id")
    base = lambda c: F.max(F.when(F.col("level") == 0, F.col(c))).over(first)
    rows = levels.withColumn("fx", F.col("size_x") / base("size_x")).withColumn("fy", F.col("size_y") / base("size_y"))
    close = lambda f: F.abs(F.col(f) - F.col(target)) <= 1e-8 + 1e-4 * F.abs(F.col(target))
    enough = (F.col("level") == 0) | ((F.col("fx") > F.col(target)) & (F.col("fy") > F.col(target))) | (close("fx") & close("fy"))
    best = rows.where(enough).groupBy("image_id").agg(F.max_by(F.struct("level", "fx", "fy", target), "level").alias("b"))
    return best.select("image_id", F.col("b.level").alias("level"), (F.col(f"b.{target}") / F.col("b.fx")).alias("factor_x"), (F.col(f"b.{target}") / F.col("b.fy")).alias("factor_y"))


def best_size(levels: DataFrame, target_x: float, target_y: float) -> DataFrame:
    """The level whose mean scale to the target is the largest up to 1; the first on ties, level 0 if none is."""
    scale = (target_x / F.col("size_x") + target_y / F.col("size_y")) / 2
    fits = F.when((scale <= 1) & (scale > 0), scale)
    rows = levels.select("image_id", "level", fits.alias("scale"))
    order = F.struct(F.col("scale"), (-F.col("level")).alias("first"))
    best = rows.groupBy("image_id").agg(F.max(F.when(F.col("scale").isNotNull(), order)).alias("b"))
    return best.select("image_id", F.coalesce(-F.col("b.first"), F.lit(0)).alias("level"))
