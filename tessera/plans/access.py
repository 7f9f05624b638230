"""Images as the user sees them: metadata from the file, regions at a wanted pixel size.

Opening an image reads its metadata only. A region at a pixel size picks the level from the catalog, scales the bounds to
that level, decodes the tiles that they touch and resizes what comes out: level and region reach the decoder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import MICROMETERS
from ..operators import compose, measure, resample, slicing
from ..sources import annotations, formats
from . import planner


@dataclass
class Image:
    """sizes: of each level, by axis; pixel_size and position: (value, unit) by axis."""

    path: str
    sizes: list[dict[str, int]]
    dtype: str
    pixel_size: dict = field(default_factory=dict)
    position: dict = field(default_factory=dict)
    channels: list = field(default_factory=list)
    rotation: float | None = None
    kept: DataFrame | None = None

    def micrometers(self, what: str = "pixel_size") -> dict[str, float]:
        return {a: v * MICROMETERS.get(u, 1.0) for a, (v, u) in getattr(self, what).items()}

    def size_at(self, pixel_size_um: dict[str, float] | None = None) -> dict[str, int]:
        """Sizes of level 0 at a pixel size, half-even."""
        full, own = self.sizes[0], self.micrometers()
        return {a: round(n * own.get(a, 1.0) / pixel_size_um[a]) if pixel_size_um and a in pixel_size_um else n for a, n in full.items()}

    def physical_size(self) -> dict[str, tuple[float, str]]:
        return {a: (self.sizes[0][a] * v, u) for a, (v, u) in self.pixel_size.items() if a in self.sizes[0]}

    def catalog(self, spark: SparkSession) -> DataFrame:
        """One row for each level: image_id, level, sizes, dtype, pixel sizes in micrometers."""
        um = self.micrometers()
        rows = [(self.path, k, *(s[a] for a in "xyzct"), self.dtype, um.get("x"), um.get("y")) for k, s in enumerate(self.sizes)]
        return spark.createDataFrame(rows, "image_id string, level int, size_x long, size_y long, size_z long, size_c long, size_t long, dtype string, pixel_x_um double, pixel_y_um double")


def open_image(spark: SparkSession, path: str, pixel_size: dict[str, tuple[float, str]] | None = None, external: str | None = None) -> Image:
    """pixel_size: given values count before the file's. external: metadata as XML beside the file, whose image of the same
    title counts."""
    low = path.lower().rstrip("/")
    if low.endswith((".tif", ".tiff")):
        pages = formats.tiff_pages(formats.Ranged(path))
        planes = formats.planes(pages)
        first = pages[0]
        title = low.rsplit("/", 1)[-1].rsplit(".", 1)[0].removesuffix(".ome")
        found = annotations.file_metadata(first, annotations.ome_tree(external) if external else None, title)
        named, _ = annotations.plane_sizes(first)
        samples = first.get("samples", 1)
        sizes = []
        for page in planes[0]:
            height, width, _ = page.shape
            sizes.append({"x": width, "y": height, "z": named.get("z", len(planes)), "c": named.get("c", 1) * samples, "t": named.get("t", 1)})
        image = Image(path, sizes, first.dtype.name, **found)
    elif low.endswith(".zarr"):
        attributes = formats.group_attributes(spark, path.rstrip("/"))
        found = formats.group_metadata(attributes) if attributes else {"axes": [], "paths": [""], "pixel_size": {}, "position": {}, "channels": []}
        arrays = [formats.Array.load(spark, f"{path.rstrip('/')}/{p}".rstrip("/")) for p in found["paths"]]
        axes = found["axes"] or list("tczyx")[5 - len(arrays[0].shape) :]
        sizes = [{a: dict(zip(axes, x.shape, strict=True)).get(a, 1) for a in "xyzct"} for x in arrays]
        image = Image(path, sizes, arrays[0].dtype.name, found["pixel_size"], found["position"], found["channels"])
    else:
        rows = sorted(formats.catalog(formats.open_image(spark, path)).collect(), key=lambda r: r["level"])
        image = Image(path, [{a: r[f"size_{a}"] for a in "xyzct"} for r in rows], rows[0]["dtype"])
    image.pixel_size = {**image.pixel_size, **{a: v for a, v in (pixel_size or {}).items() if v[0] > 0}}
    return image


def load(spark: SparkSession, image: Image) -> Image:
    """Keeps the decoded tiles in memory and on disk until unload()."""
    image.kept = formats.open_image(spark, image.path).persist()
    return image


def unload(image: Image) -> Image:
    if image.kept is not None:
        image.kept.unpersist()
        image.kept = None
    return image


def tiles(spark: SparkSession, image: Image, level: int = 0, **bounds) -> DataFrame:
    """CHUNK rows that a region of a level touches, in that level's pixels."""
    if image.kept is None and image.path.lower().endswith((".tif", ".tiff")):
        return formats.decode_segments(formats.touching(formats.tiff_segments(spark, image.path), level, **bounds))
    chunks = (image.kept if image.kept is not None else formats.open_image(spark, image.path)).where(F.col("level") == level)
    for axis, n in (("x", "w"), ("y", "h")):
        if isinstance(b := bounds.get(axis), tuple):
            chunks = chunks.where(F.col(f"{axis}0") + F.col(n) > (b[0] or 0))
            chunks = chunks.where(F.col(f"{axis}0") < b[1]) if b[1] is not None and b[1] >= 0 else chunks
    return chunks


def resized_region(px: DataFrame, sizes: dict[str, int], factor: tuple[float, float], **bounds) -> DataFrame:
    """A region of one level's pixels, with bounds in pixels of the wanted resolution, resized to that; its corner is 0, 0.
    sizes: the level's; factor: wanted pixels to the level's, along x and y."""
    for axis, f in zip("xy", factor, strict=True):
        n = sizes[axis]
        start, end = bounds.get(axis) or (0, -1)
        start = start or 0
        end = round(n * f) if end is None or end < 0 else end
        lo, hi = min(round(start / f), n), min(round(end / f), n)
        px = slicing.slice_region(px, **{axis: (lo, hi)}).withColumn(axis, F.col(axis) - lo)
        if axis == "x":
            width, new_width = hi - lo, end - start
        else:
            height, new_height = hi - lo, end - start
    return resample.resize(px, height, width, new_height, new_width)


def asarray(spark: SparkSession, image: Image, pixel_size_um: dict[str, float] | None = None, **bounds) -> DataFrame:
    """t, c, z, y, x, v of a region at a pixel size; x and y bounds count pixels of that size, a negative end is open. An
    axis with one index goes."""
    own = image.micrometers()
    wanted = pixel_size_um or {}
    ratio = [own.get(a, 1.0) / wanted[a] if wanted.get(a) else 1.0 for a in "xy"]
    # a row for each level, of one image
    levels = image.catalog(spark).select("image_id", "level", "size_x", "size_y").withColumn("target", F.lit(min(ratio)))
    best = planner.best_level(levels).first()
    level, sizes = best["level"], image.sizes[best["level"]]
    factor = tuple(r * image.sizes[0][a] / sizes[a] for r, a in zip(ratio, "xy", strict=True))
    scaled = {}
    for a, f in zip("xy", factor, strict=True):
        if isinstance(b := bounds.get(a), tuple):
            scaled[a] = (round((b[0] or 0) / f), round(b[1] / f) if b[1] is not None and b[1] >= 0 else None)
    other = {a: b for a, b in bounds.items() if a not in "xy"}
    px = formats.pixels_of(tiles(spark, image, level, **scaled, **other)).drop("image_id", "level")
    return resized_region(slicing.slice_region(px, **other), sizes, factor, **{a: bounds[a] for a in "xy" if a in bounds})


def asarray_micrometers(spark: SparkSession, image: Image, **bounds) -> DataFrame:
    own = image.micrometers()
    return asarray(spark, image, **{a: tuple(round(v / own.get(a, 1.0)) for v in b) for a, b in bounds.items()})


def thumbnail(spark: SparkSession, image: Image, size: float, rendered: bool = True) -> DataFrame:
    """The image's first plane, at most `size` long (below 1: by that factor), from the smallest level that is large enough.
    Rendered, several channels become red, green and blue, windowed and blended."""
    full = image.sizes[0]
    factor = 1 / size if size < 1 else max(full["x"], full["y"]) / size
    width, height = (max(1, round(full[a] / factor)) for a in "xy")
    level = planner.best_size(image.catalog(spark), width, height).first()["level"]
    px = formats.pixels_of(tiles(spark, image, level, t=0, z=0)).where("t = 0 and z = 0").select("c", "y", "x", "v")
    small = resample.resize(px, image.sizes[level]["y"], image.sizes[level]["x"], height, width)
    if not rendered or full["c"] in (1, 3):
        return small
    windows = measure.channel_quantiles(small, [0.001, 0.999], "c")
    colors = spark.createDataFrame([(k, *_color(image.channels, k)) for k in range(full["c"])], "c long, red double, green double, blue double, alpha double")
    mixed = compose.render(small, windows.select("c", F.col("q0").alias("low"), F.col("q1").alias("high")).join(colors, "c"))
    return mixed.select("y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "v")).select(F.col("c").cast("long").alias("c"), "y", "x", F.col("v").cast("double").alias("v"))


def _color(channels: list, k: int) -> tuple[float, float, float, float]:
    text = str(channels[k].get("color") or "").lstrip("#") if k < len(channels) else ""
    return tuple(int(text[2 * j : 2 * j + 2], 16) / 255 for j in range(3)) + (1.0,) if len(text) == 6 else (1.0, 1.0, 1.0, 1.0)
