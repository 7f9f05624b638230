"""Files: written, read back, converted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import jobs
from tessera.sources import annotations, formats, generator, sink
from tessera.streaming import watch


def picture(h=300, w=280, c=3, dtype=np.uint8):
    return (np.arange(h * w * c).reshape(h, w, c) * 7919 % 251).astype(dtype)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(dtype, compress):
    a = picture(dtype=dtype)
    data = sink.tiff_bytes([[a, a[::2, ::2]], [a[::-1]]], "MPP = 0.25", (40.0, 20.0), compress=compress)
    pages = formats.tiff_pages(data)
    assert len(pages) == 2 and pages[0].shape == a.shape and len(pages[0].sub) == 1 and pages[0].dtype == np.dtype(dtype)
    out = np.zeros_like(a)
    for level, z, c, y, x, v in formats.tiff_tiles(data):
        if (level, z) == (0, 0):
            out[y : y + v.shape[0], x : x + v.shape[1], c] = v
    assert np.array_equal(out, a)
    assert formats.pixel_size(pages[0]) == [(0.25, "µm")] * 2
    assert formats.pixel_size(formats.tiff_pages(sink.tiff_bytes([[a]], "", (40.0, 20.0)))[0]) == [(1 / 40, "cm"), (1 / 20, "cm")]


def test_read_and_catalog(spark, tmp_path):
    a = picture(c=1)
    (tmp_path / "a.tif").write_bytes(sink.tiff_bytes([[a]]))
    (tmp_path / "b.pgm").write_bytes(b"P5\n# note\n280 300\n255\n" + a[:, :, 0].tobytes())
    (tmp_path / "c.ppm").write_bytes(b"P6 280 300 255\n" + picture().tobytes())
    chunks = formats.read(spark, str(tmp_path))
    sizes = {r["image_id"][-5:]: (r["size_x"], r["size_y"], r["size_c"], r["dtype"]) for r in formats.catalog(chunks).collect()}
    assert sizes == {"a.tif": (280, 300, 1, "uint8"), "b.pgm": (280, 300, 1, "uint8"), "c.ppm": (280, 300, 3, "uint8")}
    px = formats.pixels_of(chunks)
    assert px.where("image_id like '%c.ppm'").agg(F.sum("v")).first()[0] == picture().sum()
    sink.check_corner(spark, px.where("image_id like '%a.tif'"), px.where("image_id like '%b.pgm'"))
    with pytest.raises(ValueError):
        sink.check_corner(spark, px.where("image_id like '%a.tif'"), px.where("image_id like '%b.pgm'").withColumn("v", F.col("v") + 1))
    with pytest.raises(NotImplementedError):
        formats.open_image(spark, "x.unknown")


def test_array_store(spark, tmp_path):
    a = picture(c=1)[:, :, 0]
    (tmp_path / "a.tif").write_bytes(sink.tiff_bytes([[a[:, :, None]]]))
    chunks = formats.read(spark, str(tmp_path), "*.tif")
    files = sink.array_files(chunks, 256, "uint8")
    folder = tmp_path / "s.zarr"
    assert sink.write_files(files, f"file://{folder}") == 4
    (folder / ".zarray").write_text(sink.array_metadata([1, 1, 1, 300, 280], 256, "uint8"))
    back = formats.pixels_of(formats.open_image(spark, str(folder)))
    out = np.zeros_like(a)
    for r in back.collect():
        out[r["y"], r["x"]] = r["v"]
    assert np.array_equal(out, a)


def test_tiles_and_upsert(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(sink.tiff_bytes([[picture(c=1)]]))
    chunks = formats.read(spark, str(tmp_path), "*.tif").withColumn("image_id", F.lit("a"))
    sink.write_tiles(chunks, str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert back.count() == 4
    new = chunks.where("y0 = 0 and x0 = 0").withColumn("data", F.transform("data", lambda v: v * 0))
    merged = sink.replace_tiles(chunks, new)
    assert merged.count() == 4 and merged.where("y0 = 0 and x0 = 0").select(F.aggregate("data", F.lit(0.0), lambda a, v: a + v)).first()[0] == 0
    data = sink.tiff_files(chunks).first()["content"]
    assert formats.tiff_pages(bytes(data))[0].shape == (300, 280, 1)


def test_generator(spark):
    px = generator.generate(spark, {"x": 40, "y": 30}, noise=0.0)
    assert px.count() == 40 * 30 * 3
    for r in px.where("y = 7 and x = 11").collect():
        assert r["v"] == int(np.sin(np.pi * (11 / 40 if r["c"] == 0 else 7 / 30)) * 255 + 1e-9)
    noisy = generator.generate(spark, {"x": 20, "y": 20, "z": 3}, "uint16")
    assert noisy.agg(F.min("v")).first()[0] >= 0 and noisy.agg(F.max("v")).first()[0] <= 65535 and noisy.count() == 3 * 400 * 3


def test_metadata():
    xml = annotations.image_xml("i", {"x": 5, "y": 4, "c": 3}, "uint8", [{"label": "a"}], {"x": (0.5, "µm"), "y": (0.25, "µm")}, combine_rgb=False)
    from tessera.functions import metadata

    tree = metadata.from_xml(xml)
    assert annotations.pixel_sizes(tree) == [(0.5, "µm"), (0.25, "µm")]
    assert [c["label"] for c in annotations.channel_records(tree)] == ["a", "a", "a"]
    rgb = annotations.image_xml("i", {"x": 5, "y": 4, "c": 3}, "uint8", [{"label": "a"}], {})
    assert [c["samples"] for c in annotations.channel_records(metadata.from_xml(rgb))] == [3]
    attributes = sink.image_attributes("i", {"x": 0.5, "y": 0.5, "z": 2.0}, {}, [1.0, 0.5], [])
    second = attributes["multiscales"][0]["datasets"][1]["coordinateTransformations"]
    assert second[0]["scale"] == [1.0, 1.0, 2.0, 1.0, 1.0] and second[1]["translation"] == [0, 0, 0, 0.25, 0.25]


def test_jobs(spark, tmp_path):
    a = picture(64, 48, 1)
    for name in ("p.tif", "q.tif"):
        (tmp_path / name).write_bytes(sink.tiff_bytes([[a]]))
    paths = [str(tmp_path / n) for n in ("p.tif", "q.tif")]
    job = jobs.Job.from_params({"input": {"source": paths}, "actions": ["info", "convert", "thumbnail"], "output": {"folder": str(tmp_path / "out"), "npyramid_add": 1, "thumbnail_size": 16, "break_on_error": True}})
    done = jobs.run(spark, job)
    assert len(done) == 6 and "size_x: 48" in done[0]
    levels = spark.read.parquet(done[2])
    assert {(r["level"], r["h"], r["w"]) for r in levels.collect()} == {(0, 64, 48), (1, 32, 24)}
    assert {(r["h"], r["w"]) for r in spark.read.parquet(done[4]).collect()} == {(16, 12)}
    both = jobs.run(spark, jobs.Job([[paths[0]], [paths[1]]], ["combine"], str(tmp_path / "out"), break_on_error=True))
    assert {r["c"] for r in spark.read.parquet(both[0]).collect()} == {0, 1}
    assert jobs.run(spark, jobs.Job([str(tmp_path / "none.tif")], ["info"])) == []  # logged
    with pytest.raises(Exception):  # noqa: B017
        jobs.run(spark, jobs.Job([str(tmp_path / "none.tif")], ["info"], break_on_error=True))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tif").write_bytes(sink.tiff_bytes([[picture(c=1)]]))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    watch.convert(*args).awaitTermination(120)
    (tmp_path / "in/b.tif").write_bytes(sink.tiff_bytes([[picture(20, 20, 1)]]))
    watch.convert(*args).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
