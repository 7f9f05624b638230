"""Images out: tile tables, TIFF files, chunked array folders and their metadata."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tiles(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by image and level: a reader of one level or region opens only its files and row groups. Tasks get ranges of
    rows of tiles, so that a large level is written by many."""
    chunks.repartitionByRange("image_id", "level", "z", "y0").sortWithinPartitions("image_id", "level", "c", "y0", "x0").write.mode(mode).partitionBy("image_id", "level").option("compression", "zstd").parquet(path)


def replace_tiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tiles of `new` instead of those of the same place."""
    keys = ["image_id", "level", "t", "c", "z", "y0", "x0"]
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def tiff_bytes(pages: list[list[np.ndarray]], description: str = "", resolution: tuple[float, float] | None = None, unit: int = 3, compress: bool | str = True, tile: int = 256, level: int | None = None) -> bytes:
    """A tiled TIFF; each page is a list of levels (the first full size, the others below it), height x width x channels.
    Over 4 GB of values it is a BigTIFF."""
    big = sum(a.nbytes for p in pages for a in p) > 1 << 32
    word, room = ("Q", 8) if big else ("I", 4)
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    code_of, packed = codec("deflate" if compress is True else compress or None, level)
    kinds = {"B": 1, "s": 2, "H": 3, "I": 4, "R": 5, "Q": 16}

    def put(data: bytes) -> int:
        if len(out) % 2:
            out.append(0)
        at = len(out)
        out.extend(data)
        return at

    def directory(a: np.ndarray, below: list[int], text: str) -> tuple[int, int]:
        """Where it starts, and where the offset of the next one goes."""
        height, width, samples = a.shape
        offsets, counts = [], []
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                block = np.zeros((tile, tile, samples), a.dtype.newbyteorder("<"))
                part = a[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                data = packed(block.tobytes())
                offsets.append(put(data))
                counts.append(len(data))
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        tags: dict[int, tuple[str, list]] = {256: (word, [width]), 257: (word, [height]), 258: ("H", [a.dtype.itemsize * 8] * samples), 259: ("H", [code_of]), 262: ("H", [2 if samples == 3 else 1]), 277: ("H", [samples]), 284: ("H", [1]), 322: ("H", [tile]), 323: ("H", [tile]), 324: (word, offsets), 325: (word, counts), 339: ("H", [form] * samples)}
        if text:
            tags[270] = ("s", list(text.encode() + b"\0"))
        if resolution:
            ratio = lambda v: [round(v * 1000), 1000]
            tags |= {282: ("R", ratio(resolution[0])), 283: ("R", ratio(resolution[1])), 296: ("H", [unit])}
        if below:
            tags[330] = (word, below)
        entries = b""
        for tag in sorted(tags):
            code, values = tags[tag]
            data = struct.pack(f"<{len(values)}{ {'s': 'B', 'R': 'I'}.get(code, code)}", *values)
            n = len(values) // 2 if code == "R" else len(values)
            where = data.ljust(room, b"\0") if len(data) <= room else struct.pack(f"<{word}", put(data))
            entries += struct.pack(f"<HH{word}", tag, kinds[code], n) + where
        at = put(struct.pack("<Q" if big else "<H", len(tags)) + entries + b"\0" * room)
        return at, at + (8 if big else 2) + len(entries)

    link = 8 if big else 4
    for levels in pages:
        below = [directory(a, [], "")[0] for a in levels[1:]]
        at, after = directory(levels[0], below, description)
        description = ""
        struct.pack_into(f"<{word}", out, link, at)
        link = after
    return bytes(out)


def assemble(rows, dtype: str) -> np.ndarray:
    """height x width x channels of the chunk rows of one plane."""
    h, w, c = max(r["y0"] + r["h"] for r in rows), max(r["x0"] + r["w"] for r in rows), max(r["c"] for r in rows) + 1
    out = np.zeros((h, w, c), dtype)
    for r in rows:
        out[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"], r["c"]] = np.asarray(r["data"]).reshape(r["h"], r["w"])
    return out


def plain_image(a: np.ndarray) -> bytes:
    """height x width (x 3) of one byte as a PGM or PPM file."""
    a = a[:, :, 0] if a.ndim == 3 and a.shape[2] == 1 else a
    return b"P%d %d %d 255\n" % (6 if a.ndim == 3 else 5, a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def tiff_files(chunks: DataFrame, dtype: str = "uint8", description: str = "", compress: bool | str = True, resolution: tuple[float, float] | None = None) -> DataFrame:
    """image_id and the bytes of a pyramidal TIFF for each image; an image is put together in one task, so this is for
    images that a task's memory holds (write_tiles() has no such bound)."""

    def run(key, table):
        rows = table.to_pylist()
        planes: dict[int, dict[int, list]] = {}
        for r in rows:
            planes.setdefault(r["z"], {}).setdefault(r["level"], []).append(r)
        pages = [[assemble(planes[z][level], dtype) for level in sorted(planes[z])] for z in sorted(planes)]
        return pa.table({"image_id": [key[0].as_py()], "content": pa.array([tiff_bytes(pages, description, resolution, compress=compress)], pa.binary())})

    return chunks.groupBy("image_id").applyInArrow(run, "image_id string, content binary")


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, as TIFF has them."""
    table = {bytes([k]): k for k in range(256)}
    bits, have, width, out, last = 256, 9, 9, bytearray(), b""

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    fresh = 258
    for byte in data:
        longer = last + bytes([byte])
        if longer in table:
            last = longer
            continue
        put(table[last])
        table[longer] = fresh
        fresh += 1
        if fresh == 4095:
            put(256)
            table, fresh, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if fresh < 512 else 10 if fresh < 1024 else 11 if fresh < 2048 else 12
        last = bytes([byte])
    if last:
        put(table[last])
        fresh += 1
        width = 9 if fresh < 512 else 10 if fresh < 1024 else 11 if fresh < 2048 else 12
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def codec(name: str | None, level: int | None = None) -> tuple[int, Callable[[bytes], bytes]]:
    """A TIFF compression by name: its code and what packs. None, "deflate" or "zlib" (with a level), "lzw"; the lossy ones
    need libraries that aren't here."""
    low = (name or "").lower()
    if not low or low in ("none", "raw"):
        return 1, bytes
    if "lzw" in low:
        return 5, lzw
    if "deflate" in low or "zlib" in low:
        return 8, lambda data: zlib.compress(data, 6 if level is None else level)
    raise ValueError(f"no codec for compression {name} is installed")


def array_files(chunks: DataFrame, chunk: int, dtype: str, version: int = 2, by_level: bool = False) -> DataFrame:
    """image_id, level, name and bytes of each chunk file of chunked arrays (t.c.z.y.x; in version 3 c/t/c/z/y/x), with the
    level's folder in front where by_level; tiles have to start at multiples of `chunk`. Chunks at the edge are filled up
    with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                block = np.zeros((chunk, chunk), np.dtype(dtype).newbyteorder("<"))
                block[: r["h"], : r["w"]] = np.asarray(r["data"]).reshape(r["h"], r["w"])
                index = [str(k) for k in (r["t"], r["c"], r["z"], r["y0"] // chunk, r["x0"] // chunk)]
                name = ".".join(index) if version == 2 else "/".join(["c", *index])
                data = zlib.compress(block.tobytes()) if version == 2 else gzip.compress(block.tobytes())
                out.append((r["image_id"], r["level"], f"{r['level']}/{name}" if by_level else name, data))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.binary()))], ["image_id", "level", "name", "content"])

    return chunks.mapInArrow(run, "image_id string, level int, name string, content binary")


def array_metadata(shape: list[int], chunk: int, dtype: str, version: int = 2) -> str:
    if version == 2:
        return json.dumps({"zarr_format": 2, "shape": shape, "chunks": [1, 1, 1, chunk, chunk], "dtype": np.dtype(dtype).newbyteorder("<").str, "compressor": {"id": "zlib", "level": 6}, "fill_value": 0, "order": "C", "filters": None})
    grid = {"name": "regular", "configuration": {"chunk_shape": [1, 1, 1, chunk, chunk]}}
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 6}}]
    return json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "chunk_grid": grid, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "attributes": {}})


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_group(chunks: DataFrame, folder: str, sizes: list[dict[str, int]], dtype: str, name: str = "", pixel_size_um: dict[str, float] | None = None, translation_um: dict[str, float] | None = None, channels: list[dict] | None = None, chunk: int = 256, version: int = 2) -> int:
    """A multiscale group: an array for each level, scales, translations and channels. chunks: CHUNK rows of all levels, in
    tiles of `chunk`; sizes: of each level. Returns the number of chunk files, which tasks write."""
    spark = chunks.sparkSession
    n = write_files(array_files(chunks, chunk, dtype, version, by_level=True), folder)
    for k, s in enumerate(sizes):
        write_text(spark, f"{folder}/{k}/{'.zarray' if version == 2 else 'zarr.json'}", array_metadata([s[a] for a in "tczyx"], chunk, dtype, version))
    scales = [s["x"] / sizes[0]["x"] for s in sizes]
    attributes = image_attributes(name, pixel_size_um or {}, translation_um or {}, scales, channels or [])
    if version == 2:
        write_text(spark, f"{folder}/.zgroup", json.dumps({"zarr_format": 2}))
        write_text(spark, f"{folder}/.zattrs", json.dumps(attributes))
    else:
        write_text(spark, f"{folder}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": attributes}}))
    return n


def image_attributes(name: str, pixel_size_um: dict[str, float], translation_um: dict[str, float], scales: list[float], channels: list[dict], order: str = "tczyx") -> dict:
    """Multiscale metadata: axes, a scale for each level (x and y grow), a translation where there is one, channels."""
    kind = {"t": "time", "c": "channel"}
    axes = [{"name": a, "type": kind.get(a, "space")} | ({"unit": "micrometer"} if a in "xyz" else {}) for a in order]
    datasets = []
    for k, s in enumerate(scales):
        scale = [(pixel_size_um.get(a, 1.0) / (s if a in "xy" else 1)) or 1.0 for a in order]
        moved = [translation_um.get(a, 0.0) + ((1 / s - 1) * pixel_size_um.get(a, 0.0) / 2 if a in "xy" else 0.0) for a in order]
        transforms = [{"type": "scale", "scale": scale}]
        if any(moved):
            transforms.append({"type": "translation", "translation": moved})
        datasets.append({"path": str(k), "coordinateTransformations": transforms})
    return {"multiscales": [{"version": "0.4", "name": name, "axes": axes, "datasets": datasets}], "omero": {"version": "0.4", "channels": channels}}


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Binary rows as files in any store that Spark reaches, each written by the task that holds it; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        store, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(base)
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if "/" in key:
                    store.create_dir(f"{base}/{key.rsplit('/', 1)[0]}")
                with store.open_output_stream(f"{base}/{key}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    return files.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string").count()


def check_corner(spark: SparkSession, a: DataFrame, b: DataFrame, size: int = 16) -> None:
    """Raises ValueError unless both images (long form) agree in a corner at t = z = 0."""
    corner = lambda px: px.where((F.col("x") < size) & (F.col("y") < size) & (F.col("z") == 0) & (F.col("t") == 0)).select("c", "y", "x", "v")
    off = corner(a).exceptAll(corner(b)).count() + corner(b).exceptAll(corner(a)).count()
    if off:
        raise ValueError(f"the written image differs from its source in {off} values")
