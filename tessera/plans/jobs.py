"""Jobs from parameters: info, thumbnail, convert and combine over image files."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import collection, compose, resample, slicing
from ..sources import annotations, formats, sink
from . import access

log = logging.getLogger(__name__)


@dataclass
class Job:
    """What to do with which images, and where the results go."""

    sources: list
    actions: list[str]
    output: str = ""
    levels: int = 0
    downsample: int = 2
    thumbnail: float = 1000
    overwrite: bool = True
    break_on_error: bool = False
    operations: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    format: str = "tiles"
    compression: str | None = "deflate"
    pixel_size: dict = field(default_factory=dict)

    @classmethod
    def from_params(cls, params: dict) -> "Job":
        out = params.get("output", {})
        return cls(params["input"]["source"], params.get("actions", []), out.get("folder", ""), out.get("npyramid_add", 0), out.get("pyramid_downsample", 2), out.get("thumbnail_size", 1000), out.get("overwrite", True), out.get("break_on_error", False), format=out.get("format", "tiles"), compression=out.get("compression", "deflate"))


def output_path(path: str, folder: str, ending: str) -> str:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    title = base.rsplit(".", 1)[0].removesuffix(".ome")
    return f"{folder}/{title}{ending}"


def load(spark: SparkSession, path: str, operations=()) -> DataFrame:
    px = formats.pixels_of(formats.open_image(spark, path))
    for f in operations:
        px = px.transform(f)
    return px


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row for each level, from the file's metadata."""
    return access.open_image(spark, path).catalog(spark)


def _tiles(px: DataFrame, image_id: str, size: int = formats.TILE) -> DataFrame:
    """Long form to tiles; pixels without a row are 0."""
    rows = slicing.pack(px, size, size, "level", "t", "c", "z")
    place = [(F.col("ty") * size).alias("y0"), (F.col("tx") * size).alias("x0")]
    return rows.select(F.lit(image_id).alias("image_id"), F.col("level").cast("int").alias("level"), "t", "c", "z", *place, "h", "w", F.lit("float64").alias("dtype"), "data")


def _written(spark: SparkSession, levels: DataFrame, image: access.Image, out: str, job: Job) -> DataFrame:
    """Levels in long form, written as the job's format says; the same read back. TIFF files are put together by one task
    each; tiles and array groups are written by many."""
    chunks = _tiles(levels, image.path)
    if "zarr" in job.format:
        sizes = [image.sizes[0] | {a: max(1, round(image.sizes[0][a] / job.downsample**k)) for a in "xy"} for k in range(job.levels + 1)]
        sink.write_group(chunks, out, sizes, image.dtype, out.rsplit("/", 1)[-1], image.micrometers(), image.micrometers("position"), [{"label": c.get("label", "")} for c in image.channels], version=3 if "3" in job.format else 2)
        return formats.pixels_of(formats.zarr(spark, out))
    if "tif" in job.format:
        um = image.micrometers()
        resolution = (1e4 / um["x"], 1e4 / um["y"]) if um.get("x") and um.get("y") else None
        xml = annotations.image_xml(out.rsplit("/", 1)[-1], image.sizes[0], image.dtype, image.channels, {a: (v, "µm") for a, v in um.items()}, combine_rgb=False)
        # channels of a plane are samples of one page
        files = sink.tiff_files(chunks, image.dtype, xml if "ome" in job.format else "", job.compression or False, resolution)
        sink.write_files(files.select(F.lit(out.rsplit("/", 1)[-1]).alias("name"), "content"), out.rsplit("/", 1)[0])
        return formats.pixels_of(formats.tiff(spark, out))
    sink.write_tiles(chunks, out, "overwrite")
    return formats.pixels_of(spark.read.parquet(out).withColumn("image_id", F.lit(image.path)))


ENDINGS = {"zarr": ".ome.zarr", "zarr3": ".ome.zarr", "ome.zarr": ".ome.zarr", "tiff": ".tiff", "tif": ".tif", "ome.tiff": ".ome.tiff", "ome.tif": ".ome.tif"}


def convert(spark: SparkSession, path: str, job: Job) -> str:
    """The image with its pyramid in the job's format, then a check of a corner against the source. What is there already
    stays unless the job overwrites."""
    out = output_path(path, job.output, ENDINGS.get(job.format, ".tiles"))
    if not job.overwrite and exists(spark, out):
        return out
    image = access.open_image(spark, path, job.pixel_size)
    px = formats.pixels_of(access.tiles(spark, image)).drop("level", "image_id")
    for f in job.operations:
        px = px.transform(f)
    levels = resample.pyramid(px.select("t", "c", "z", "y", "x", F.col("v").cast("double").alias("v")), job.levels, job.downsample)
    written = _written(spark, levels, image, out, job)
    corner = formats.pixels_of(access.tiles(spark, image, x=(0, 16), y=(0, 16)))  # only the tiles of the corner again
    if not job.operations:
        sink.check_corner(spark, corner, written.where("level = 0"))
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sources(spark: SparkSession, named: list | str) -> list[str]:
    """Files of paths, patterns and folders, sorted; a folder counts as its files unless it is a chunked array."""
    out: list[str] = []
    for name in [named] if isinstance(named, str) else named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = list(store.globStatus(at) or [])
        if not found and not any(c in name for c in "*?[{"):
            out.append(name)  # it will fail where it is opened
        for f in found:
            here = f.getPath()
            if f.isDirectory() and not here.getName().endswith((".zarr", ".tiles", ".parquet")):
                out += sorted(x.getPath().toString() for x in store.listStatus(here) if not x.isDirectory() or x.getPath().getName().endswith(".zarr"))
            else:
                out.append(here.toString() if name != here.toUri().getPath() else name)
    return sorted(out)


def thumbnail(spark: SparkSession, path: str, job: Job) -> list[str]:
    """A size below 1 is a factor, else the length of the longer side. From the smallest level that is large enough; one
    table for images of one or three channels, else the rendered image and one table for each channel."""
    image = access.open_image(spark, path, job.pixel_size)
    small = access.thumbnail(spark, image, job.thumbnail, rendered=False)
    out = output_path(path, job.output, "_thumb.tiles")
    plane = lambda px: px.selectExpr("0 as level", "0L as t", "c", "0L as z", "y", "x", "v")
    n = image.sizes[0]["c"]
    if n in (1, 3):
        sink.write_tiles(_tiles(plane(small), path), out)
        return [out]
    sink.write_tiles(_tiles(plane(access.thumbnail(spark, image, job.thumbnail)), path), out)
    done = [out]
    for k, px in enumerate(compose.split_channels(small, n)):
        done.append(output_path(path, job.output, f"_channel{k}_thumb.tiles"))
        sink.write_tiles(_tiles(plane(px.withColumn("c", F.lit(0).cast("long"))), path), done[-1])
    return done


def store_tiles(spark: SparkSession, layout: DataFrame, folder: str, pixel_size_um: dict[str, float], job: Job) -> list[str]:
    """A collection of tiles (path, sx, sy) as groups that know their place: translations come from stage positions. The
    images are a list of files, whose pixels tasks read and write."""
    done = []
    for r in sorted(collection.stage_positions(layout, pixel_size_um).collect(), key=lambda r: r["path"]):
        image = access.open_image(spark, r["path"], {a: (v, "µm") for a, v in pixel_size_um.items()})
        image.position = {"x": (r["x_um"], "µm"), "y": (r["y_um"], "µm")}
        px = formats.pixels_of(access.tiles(spark, image)).select("t", "c", "z", "y", "x", F.col("v").cast("double").alias("v"))
        for f in job.operations:
            px = px.transform(f)
        out = output_path(r["path"], folder, ".ome.zarr")
        _written(spark, resample.pyramid(px, job.levels, job.downsample), image, out, replace(job, format="ome.zarr"))
        done.append(out)
    return done


def combine(spark: SparkSession, paths: list[str], job: Job) -> str:
    images = []
    for path in paths:
        px = load(spark, path).where("level = 0").select("t", "c", "z", "y", "x", "v")
        images.append((px, px.agg(F.max("c") + 1).first()[0]))
    out = output_path(paths[0], job.output, "_combined.tiles")
    levels = resample.pyramid(compose.combine(images), job.levels, job.downsample)
    sink.write_tiles(_tiles(levels, out), out)
    return out


def run(spark: SparkSession, job: Job) -> list[str]:
    """All actions over all sources (see sources()). Errors are logged, or end the job where break_on_error. "combine" takes lists of
    sources side by side, as far as the shortest goes."""
    done = []
    for action in job.actions:
        if "combine" in action:
            items = [list(group) for group in zip(*[sources(spark, s) for s in job.sources], strict=False)]
        else:
            items = [s for group in ([job.sources] if isinstance(job.sources, str) else job.sources) for s in sources(spark, group)]
        for item in items:
            try:
                if "combine" in action:
                    done.append(combine(spark, item, job))
                elif "thumb" in action:
                    done += thumbnail(spark, item, job)
                elif "convert" in action:
                    done.append(convert(spark, item, job))
                else:
                    done.append("\n".join(metadata.outline(r.asDict()) for r in info(spark, item).collect()))
            except Exception:
                log.exception("%s of %s", action, item)
                if job.break_on_error:
                    raise
    return done


def main(arguments: list[str] | None = None) -> list[str]:
    """python -m tessera.plans.jobs --params FILE: a job from a JSON or YAML file."""
    import argparse

    parser = argparse.ArgumentParser(description="Jobs over image files")
    parser.add_argument("--params", required=True)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    done = run(spark, Job.from_params(metadata.read_tree(parser.parse_args(arguments).params)))
    for line in done:
        print(line)
    return done


if __name__ == "__main__":
    main()
