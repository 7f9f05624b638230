"""Metadata of files, pruned reads, regions at a pixel size, array groups, jobs in several formats."""

import json

import numpy as np
import pytest

from tessera.functions import metadata
from tessera.plans import access, jobs
from tessera.sources import annotations, formats, sink


def picture(h, w, c=1, dtype=np.uint8):
    return (np.arange(h * w * c).reshape(h, w, c) * 7919 % 251).astype(dtype)


def dense(px, h, w, c=1):
    out = np.zeros((h, w, c))
    for r in px.collect():
        out[r["y"], r["x"], r["c"]] = r["v"]
    return out


def means(a, k=2):
    return a.reshape(a.shape[0] // k, k, a.shape[1] // k, k, -1).mean((1, 3))


def test_codecs():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 9000, bytes(rng.integers(0, 256, 20_000, dtype=np.uint8)), bytes(rng.integers(0, 3, 60_000, dtype=np.uint8))):
        assert formats.unpack_lzw(sink.lzw(data)) == data
    assert formats.unpack_bits(b"\x02abc\xfed\x80\x00e") == b"abcddde"
    a = rng.standard_normal((4, 6, 2)).astype("<f4")
    raw = a.astype(">f4").reshape(4, 12, 1).view(np.uint8).reshape(4, 12, 4).transpose(0, 2, 1).reshape(4, -1, 2)
    packed = np.diff(raw.astype(np.int16), axis=1, prepend=np.zeros((4, 1, 2), np.int16)).astype(np.uint8).tobytes()
    assert np.array_equal(formats.decode_block(packed, 1, np.dtype("<f4"), (4, 6, 2), 3), a)
    with pytest.raises(ValueError):
        formats.decode_block(b"", 7, np.dtype("u1"), (1, 1, 1), 1)
    for compress in ("lzw", "deflate", None):
        page = picture(40, 50, 3)
        data = sink.tiff_bytes([[page]], compress=compress or False, tile=16)
        out = np.zeros_like(page)
        for _, _, c, y, x, v in formats.tiff_tiles(data):
            out[y : y + v.shape[0], x : x + v.shape[1], c] = v
        assert np.array_equal(out, page)
    with pytest.raises(ValueError):
        sink.codec("jpegxl")


def test_smaller_pages_are_levels():
    a = picture(64, 48)
    pages = formats.tiff_pages(sink.tiff_bytes([[a], [a[::2, ::2]], [a[::4, ::4]], [a], [a[::2, ::2]]]))
    assert [[p.shape[:2] for p in levels] for levels in formats.planes(pages)] == [[(64, 48), (32, 24), (16, 12)], [(64, 48), (32, 24)]]
    assert [formats.place(k, {"z": 2, "c": 3, "t": 2}, "XYCZT") for k in (0, 2, 3, 6)] == [{"t": 0, "c": 0, "z": 0}, {"t": 0, "c": 2, "z": 0}, {"t": 0, "c": 0, "z": 1}, {"t": 1, "c": 0, "z": 0}]


def test_regions_decode_only_what_they_touch(spark, tmp_path):
    a = picture(160, 128)
    (tmp_path / "a.tif").write_bytes(sink.tiff_bytes([[a, means(a).astype(np.uint8), means(a, 4).astype(np.uint8)]], "MPP = 0.5", tile=16))
    path = str(tmp_path / "a.tif")
    image = access.open_image(spark, path)
    assert [(s["x"], s["y"]) for s in image.sizes] == [(128, 160), (64, 80), (32, 40)] and image.pixel_size == {"x": (0.5, "µm"), "y": (0.5, "µm")}
    assert image.physical_size()["x"] == (64.0, "µm") and image.size_at({"x": 1.0, "y": 2.0})["y"] == 40
    segments = formats.tiff_segments(spark, path)
    assert segments.count() == 80 + 20 + 6
    assert formats.touching(segments, 0, x=(20, 40), y=(0, 16)).count() == 2
    assert np.array_equal(dense(access.asarray(spark, image, x=(20, 50), y=(7, -1)), 153, 30), a[7:, 20:50])
    # 1 micrometer: level 1 as it is
    half = access.asarray(spark, image, {"x": 1.0, "y": 1.0}, x=(4, 40), y=(8, 20))
    assert np.array_equal(dense(half, 12, 36), means(a).astype(np.uint8)[8:20, 4:40])
    # 1.5 micrometers: level 1 and a third less
    third = access.asarray(spark, image, {"x": 1.5, "y": 1.5}, x=(0, 10), y=(0, 10))
    assert third.count() == 100
    um = access.asarray_micrometers(spark, image, x=(10.0, 25.0), y=(3.5, 10.0))
    assert np.array_equal(dense(um, 13, 30), a[7:20, 20:50])
    assert access.thumbnail(spark, image, 40).count() == 40 * 32
    kept = access.load(spark, image)
    assert np.array_equal(dense(access.asarray(spark, kept, x=(0, 9), y=(0, 9)), 9, 9), a[:9, :9])
    assert access.unload(kept).kept is None


def test_file_metadata():
    a = picture(8, 8)
    xml = annotations.image_xml("one", {"x": 8, "y": 8, "c": 1, "z": 2}, "uint8", [{"label": "DAPI"}], {"x": (0.25, "µm"), "y": (250.0, "nm")})
    xml = xml.replace("<Channel", '<Plane PositionX="3" PositionXUnit="mm" PositionY="4" TheZ="0"/><Channel', 1)
    page = lambda text, **more: formats.tiff_pages(sink.tiff_bytes([[a]], text, **more))[0]
    found = annotations.file_metadata(page(xml))
    assert found["pixel_size"] == {"x": (0.25, "µm"), "y": (250.0, "nm")} and found["position"] == {"x": (3.0, "mm"), "y": (4.0, "µm")} and found["channels"][0]["label"] == "DAPI"
    assert annotations.plane_sizes(page(xml))[0] == {"c": 1, "z": 2, "t": 1}
    imagej = annotations.file_metadata(page("ImageJ=1.5\nunit=micron\nspacing=2.5\nslices=3", resolution=(4.0, 5.0)))
    assert imagej["pixel_size"] == {"x": (0.25, "µm"), "y": (0.2, "µm"), "z": (2.5, "µm")}
    assert annotations.file_metadata(page("AppMag = 20|MPP = 0.5"))["pixel_size"] == {"x": (0.5, "µm"), "y": (0.5, "µm")}
    plain = annotations.file_metadata(page("", resolution=(40.0, 20.0)))
    assert plain["pixel_size"] == {"x": (1 / 40, "cm"), "y": (1 / 20, "cm")} and plain["channels"] == [{"label": "MINISBLACK", "samples": 1}]
    two = metadata.from_xml('<OME><Image Name="a"><Pixels PhysicalSizeX="1"/></Image><Image Name="B"><Pixels PhysicalSizeX="2"/></Image></OME>')
    assert annotations.file_metadata(page(""), two, "b")["pixel_size"] == {"x": (2.0, "µm")}
    turned = metadata.from_xml('<OME><Image><Pixels><Modulo><ModuloAlongZ Unit="rad"><Label>3.14159265358979</Label></ModuloAlongZ></Modulo></Pixels></Image></OME>')
    assert annotations.rotation_of(turned) == pytest.approx(180)
    tree = metadata.from_xml(annotations.mapped_xml({"OME.Image.@Name": "m", "OME.Image.Pixels.@PhysicalSizeX": 0.5, "OME.Image.Pixels.Plane": {"@PositionX": 1.0}}, {"x": 8, "y": 8, "c": 2}, "uint16"))
    assert metadata.lookup(tree, "OME.Image.Pixels.SizeX") == "8" and metadata.lookup(tree, "OME.Image.Pixels.Plane.TheZ") == "0" and len(tree["OME"]["Image"]["Pixels"]["Channel"]) == 2


def test_record_metadata():
    record = {
        "objective": {"Model": "40x", "WorkingDistance": (0.17, "mm"), "Immersion": "Unknown", "Iris": None},
        "stage": {"Name": "s1", "PositionX": (3.0, "mm"), "PositionY": (4.0, "mm")},
        "planes": [{"TheC": 0, "TheZ": 0, "TheT": 0, "ExposureTime": 0.5}, {"TheC": 1, "TheZ": 0, "TheT": 0}],
        "channels": [{"Name": "DAPI", "Color": 255, "Fluor": None}, {"Name": "GFP", "Color": 65280}],
        "description": "two channels",
        "annotations": [{"type": "TagAnnotation", "namespace": "n", "value": "good"}, {"type": "MapAnnotation", "value": [("k", 1), ("l", "v")]}],
    }
    tree = metadata.from_xml(annotations.record_xml("r", {"x": 64, "y": 32, "c": 2}, "uint16", record, {"x": (0.5, "µm"), "y": (0.5, ""), "z": (0, "µm")}, [(32, 16), (16, 8)]))
    at = lambda path: metadata.lookup(tree, path)
    objective = at("OME.Instrument.Objective")
    assert objective["@WorkingDistance"] == "0.17" and objective["@WorkingDistanceUnit"] == "mm" and "@Immersion" not in objective and "@Iris" not in objective
    assert at("OME.Image.ObjectiveSettings.ID") == objective["@ID"] and at("OME.Image.StageLabel.Name") == "s1" and at("OME.Image.Pixels.SizeX") == "64"
    assert [c["@Name"] for c in at("OME.Image.Pixels.Channel")] == ["DAPI", "GFP"] and [p["@TheC"] for p in at("OME.Image.Pixels.Plane")] == ["0", "1"]
    assert at("OME.Image.Pixels.Plane")[0]["@PositionXUnit"] == "mm" and at("OME.Image.Pixels.PhysicalSizeYUnit") is None and at("OME.Image.Pixels.PhysicalSizeZ") is None
    first, second = at("OME.StructuredAnnotations.MapAnnotation")
    assert [m["#text"] for m in first["Value"]["M"]] == ["32 16", "16 8"] and [m["@K"] for m in second["Value"]["M"]] == ["k", "l"]
    assert at("OME.StructuredAnnotations.TagAnnotation.Value") == "good"
    rgb = metadata.from_xml(annotations.record_xml("r", {"x": 8, "y": 8, "c": 3}, "uint8", {"channels": [{"Name": "rgb", "Color": 1, "SamplesPerPixel": 1}]}))
    assert metadata.lookup(rgb, "OME.Image.Pixels.Channel.SamplesPerPixel") == "3" and metadata.lookup(rgb, "OME.Image.Pixels.Channel.Color") is None
    assert metadata.lookup(metadata.from_xml(annotations.record_xml("e", {"x": 1, "y": 1}, "uint8", {})), "OME.Image.Name") == "e"


@pytest.mark.parametrize("version", [2, 3])
def test_groups(spark, tmp_path, version):
    a = picture(80, 48, 2)
    (tmp_path / "a.tif").write_bytes(sink.tiff_bytes([[a, means(a).astype(np.uint8)]], tile=32))
    chunks = formats.tiff(spark, str(tmp_path / "a.tif"))
    sizes = [{"t": 1, "c": 2, "z": 1, "y": 80 >> k, "x": 48 >> k} for k in range(2)]
    folder = str(tmp_path / "g.ome.zarr")
    n = sink.write_group(chunks, folder, sizes, "uint8", "g", {"x": 0.5, "y": 0.5}, {"x": 10.0}, [{"label": "a"}, {"label": "b"}], 32, version)
    assert n == 2 * (3 * 2 + 2 * 1)
    image = access.open_image(spark, folder)
    assert [(s["x"], s["y"], s["c"]) for s in image.sizes] == [(48, 80, 2), (24, 40, 2)] and image.dtype == "uint8"
    assert image.pixel_size["x"] == (0.5, "micrometer") and image.position["x"] == (10.0, "micrometer") and [c["label"] for c in image.channels] == ["a", "b"]
    assert np.array_equal(dense(access.asarray(spark, image, y=(30, 60), x=(0, -1)), 30, 48, 2), a[30:60])
    assert np.array_equal(dense(access.asarray(spark, image, {"x": 1.0, "y": 1.0}), 40, 24, 2), means(a).astype(np.uint8))
    assert formats.open_image(spark, folder).where("level = 1").count() == 4
    bare = formats.zarr(spark, f"{folder}/0")
    assert bare.select("level").distinct().collect() == [(0,)]
    with pytest.raises(FileNotFoundError):
        formats.zarr(spark, str(tmp_path / "none.zarr"))


def test_bmp(spark, tmp_path):
    a = picture(5, 7, 3)
    rows = b"".join(r[:, ::-1].tobytes().ljust(24, b"\0") for r in a[::-1])
    (tmp_path / "a.bmp").write_bytes(b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24) + rows)
    assert np.array_equal(dense(formats.pixels_of(formats.open_image(spark, str(tmp_path / "a.bmp"))), 5, 7, 3), a)
    assert formats.pnm(sink.plain_image(a)).tolist() == a.tolist()


@pytest.mark.parametrize("kind", ["ome.tiff", "ome.zarr", "zarr3", "tiles"])
def test_jobs_write_formats(spark, tmp_path, kind):
    a = picture(64, 48, 1)
    (tmp_path / "in").mkdir()
    for name in ("p.tif", "q.tif"):
        (tmp_path / "in" / name).write_bytes(sink.tiff_bytes([[a]], "MPP = 0.5", tile=32))
    params = {"input": {"source": [str(tmp_path / "in" / "*.tif")]}, "actions": ["convert"], "output": {"folder": str(tmp_path / "out"), "npyramid_add": 1, "format": kind, "break_on_error": True, "compression": "lzw"}}
    (tmp_path / "p.json").write_text(json.dumps(params))
    (tmp_path / "out").mkdir()
    done = jobs.main(["--params", str(tmp_path / "p.json")])
    assert len(done) == 2 and done == sorted(done)
    if kind != "tiles":
        image = access.open_image(spark, done[0])
        assert [(s["x"], s["y"]) for s in image.sizes] == [(48, 64), (24, 32)] and image.micrometers()["x"] == pytest.approx(0.5)
        assert np.array_equal(dense(access.asarray(spark, image, x=(3, 20), y=(2, 60)), 58, 17), a[2:60, 3:20])
    again = jobs.run(spark, jobs.Job.from_params(params | {"input": {"source": str(tmp_path / "in")}, "output": params["output"] | {"overwrite": False}}))
    assert again == done


def test_thumbnails_of_several_channels(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(sink.tiff_bytes([[picture(64, 48, 2)]]))
    done = jobs.thumbnail(spark, str(tmp_path / "a.tif"), jobs.Job([], [], str(tmp_path / "out"), thumbnail=16))
    assert [d.rsplit("/", 1)[1] for d in done] == ["a_thumb.tiles", "a_channel0_thumb.tiles", "a_channel1_thumb.tiles"]
    assert [spark.read.parquet(d).count() for d in done] == [3, 1, 1]


def test_store_tiles(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"t{k}.tif").write_bytes(sink.tiff_bytes([[picture(16, 16)]], tile=16))
    layout = spark.createDataFrame([(str(tmp_path / f"t{k}.tif"), 10 * k, 20) for k in range(2)], "path string, sx long, sy long")
    done = jobs.store_tiles(spark, layout, str(tmp_path / "out"), {"x": 0.5, "y": 0.5}, jobs.Job([], []))
    assert [access.open_image(spark, d).position["x"][0] for d in done] == [0.0, 5.0]
