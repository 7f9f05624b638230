"""Files as images: TIFF (uncompressed, deflate, LZW, PackBits), PNM, BMP and chunked arrays, decoded by numpy on the executors.

read() takes whole files through Spark (binaryFile), so any store that Spark reaches will do; a task decodes one file at a
time, whose bytes it holds, and returns tiles. tiff_segments() and decode_segments() read byte ranges instead: a row for
each stored tile comes first, filters on level and region drop rows, and only what is left is fetched and decoded.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256
CHUNK = "image_id string, level int, t long, c long, z long, y0 long, x0 long, h long, w long, dtype string, data array<double>"
#: Codes of the TIFF format.
_TAG = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 270: "description", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_counts", 282: "x_resolution", 283: "y_resolution", 284: "planar", 286: "x_position", 287: "y_position", 296: "resolution_unit", 305: "software", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 330: "sub_ifds", 339: "sample_format"}
_KIND = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
_FORMAT = {1: "u", 2: "i", 3: "f"}


@dataclass
class Page:
    """One directory of a TIFF file."""

    order: str
    tags: dict = field(default_factory=dict)
    sub: list["Page"] = field(default_factory=list)

    def get(self, name: str, default=None):
        value = self.tags.get(name, default)
        return value[0] if isinstance(value, tuple) and len(value) == 1 else value

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.get("height"), self.get("width"), self.get("samples", 1)

    @property
    def dtype(self) -> np.dtype:
        first = lambda x: x[0] if isinstance(x, tuple) else x
        return np.dtype(f"{self.order}{_FORMAT[first(self.get('sample_format', 1))]}{first(self.get('bits', 8)) // 8}")

    def segments(self) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """Plane, y0, x0, rows and columns as stored, offset and byte count of each tile or strip."""
        height, width, samples = self.shape
        many = lambda x: x if isinstance(x, tuple) else (x,)
        if tiled := self.get("tile_offsets") is not None:
            h, w, offsets, counts = self.get("tile_height"), self.get("tile_width"), many(self.get("tile_offsets")), many(self.get("tile_counts"))
        else:
            h, w, offsets, counts = min(self.get("rows_per_strip", height), height), width, many(self.get("strip_offsets")), many(self.get("strip_counts"))
        down, across = -(-height // h), -(-width // w)
        planes = samples if self.get("planar", 1) == 2 else 1
        for k, (offset, n) in enumerate(zip(offsets, counts, strict=True)):
            plane, at = divmod(k, down * across)
            if plane >= planes:
                return
            y, x = at // across * h, at % across * w
            yield plane, y, x, h if tiled else min(h, height - y), w, offset, n


class Ranged:
    """Bytes of a file by position, fetched in blocks; a store is named by its URI."""

    BLOCK = 1 << 16

    def __init__(self, path: str):
        import pyarrow.fs as fs

        store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")
        self.file, self.blocks = store.open_input_file(at), {}

    def __call__(self, at: int, n: int) -> bytes:
        if n > self.BLOCK:
            return self.file.read_at(n, at)
        out = b""
        for k in range(at // self.BLOCK, (at + n - 1) // self.BLOCK + 1):
            if k not in self.blocks:
                self.blocks[k] = self.file.read_at(self.BLOCK, k * self.BLOCK)
            out += self.blocks[k]
        start = at - at // self.BLOCK * self.BLOCK
        return out[start : start + n]


def tiff_pages(data: bytes | Ranged) -> list[Page]:
    """The directories of a file, given as its bytes or as a function of position and length."""
    read = data if callable(data) else lambda at, n: data[at : at + n]
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or (version := struct.unpack(f"{order}H", head[2:4])[0]) not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    room, word = (8, "Q") if big else (4, "I")

    def number(code: str, raw: bytes) -> int:
        return struct.unpack_from(order + code, raw)[0]

    def value(entry: bytes):
        tag, kind = struct.unpack_from(f"{order}HH", entry)
        if kind not in _KIND or tag not in _TAG:
            return None
        count = number(word, entry[4:])
        code, width = _KIND[kind]
        raw = entry[4 + room :] if width * count <= room else read(number(word, entry[4 + room :]), width * count)
        if code == "s":
            return raw[:count].split(b"\0")[0].decode("utf-8", "replace")
        values = struct.unpack_from(f"{order}{len(code) * count}{code[0]}", raw)
        return tuple(zip(values[::2], values[1::2], strict=True)) if len(code) == 2 else values

    def directory(at: int) -> tuple[Page, int]:
        page, n = Page(order), number("Q" if big else "H", read(at, 8))
        at += 8 if big else 2
        size = 4 + 2 * room
        rows = read(at, n * size + room)
        for k in range(n):
            entry = rows[k * size : (k + 1) * size]
            if (v := value(entry)) is not None:
                page.tags[_TAG[number("H", entry)]] = v
        for below in page.tags.get("sub_ifds", ()):
            page.sub.append(directory(below)[0])
        return page, number(word, rows[n * size :])

    pages, at, seen = [], number(word, head[8 if big else 4 :]), set()
    while at and at not in seen:
        seen.add(at)
        page, at = directory(at)
        pages.append(page)
    return pages


def planes(pages: list[Page]) -> list[list[Page]]:
    """Pages as planes, each a list of levels: sub-directories are levels, and so are pages in a row that get smaller."""
    out: list[list[Page]] = []
    for page in pages:
        size = page.shape[:2]
        if out and size < out[0][0].shape[:2] and all(a < b for a, b in zip(size, out[-1][-1].shape[:2], strict=True)):
            out[-1].append(page)
        elif not out or size == out[0][0].shape[:2]:
            out.append([page, *page.sub])
    return out


def place(index: int, sizes: dict[str, int], order: str) -> dict[str, int]:
    """t, c, z of the index-th plane; order: the axes, the fastest first."""
    out = {"t": 0, "c": 0, "z": 0}
    for axis in order.lower():
        if axis in out:
            index, out[axis] = divmod(index, max(1, sizes.get(axis, 1)))
    return out


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 starts anew, 257 ends."""
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, width, have, bits = list(first), [], b"", 9, 0, 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = list(first), b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count below 128 copies so many bytes and one, above 128 repeats the next byte 257 less the count times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


UNPACK = {1: lambda data: data, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode_block(data: bytes, how: int, dtype: np.dtype, shape: tuple[int, int, int], predictor: int) -> np.ndarray:
    """rows x columns x samples of one tile or strip. Other codecs can be put into UNPACK."""
    if how not in UNPACK:
        raise ValueError(f"TIFF compression {how} needs a codec that isn't installed")
    data = UNPACK[how](data)
    if predictor == 3:  # bytes of a row by significance, as differences
        rows, columns, samples = shape
        raw = np.frombuffer(data, np.uint8, rows * columns * samples * dtype.itemsize).reshape(rows, -1, samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, columns * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape).astype(dtype.newbyteorder("="))
    if predictor not in (1, 2):
        raise ValueError(f"TIFF predictor {predictor} is unknown")
    out = np.frombuffer(data, dtype, int(np.prod(shape))).reshape(shape)
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def decode_segment(page: Page, data: bytes, rows: int, columns: int) -> np.ndarray:
    samples = 1 if page.get("planar", 1) == 2 else page.get("samples", 1)
    return decode_block(data, page.get("compression", 1), page.dtype, (rows, columns, samples), page.get("predictor", 1))


def tiff_tiles(data: bytes) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """Level, z, c, y0, x0 and values of every stored tile, clipped to the image."""
    for z, levels in enumerate(planes(tiff_pages(data))):
        for level, page in enumerate(levels):
            height, width, _ = page.shape
            for plane, y, x, h, w, offset, n in page.segments():
                tile = decode_segment(page, data[offset : offset + n], h, w)[: height - y, : width - x]
                for k in range(tile.shape[2]):
                    yield level, z, plane + k, y, x, tile[:, :, k]


SEGMENT = "image_id string, level int, t long, c long, z long, y0 long, x0 long, rows long, columns long, height long, width long, offset long, bytes long, compression int, predictor int, samples int, dtype string"


def tiff_segments(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row for each stored tile or strip of the TIFF files below a path, read from their directories alone. c is the first
    of `samples` channels."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import annotations

        for b in batches:
            for name in b.column(0).to_pylist():
                found = planes(tiff_pages(Ranged(name)))
                sizes, order = annotations.plane_sizes(found[0][0]) if found else ({}, "")
                rows = []
                for k, levels in enumerate(found):
                    at = place(k, sizes, order) if sizes else {"t": 0, "c": 0, "z": k}
                    for level, page in enumerate(levels):
                        height, width, _ = page.shape
                        samples = 1 if page.get("planar", 1) == 2 else page.get("samples", 1)
                        for plane, y, x, h, w, offset, n in page.segments():
                            rows.append((name, level, at["t"], at["c"] + plane, at["z"], y, x, h, w, height, width, offset, n, page.get("compression", 1), page.get("predictor", 1), samples, page.dtype.str))
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 10_000]], t) for k, t in enumerate(_arrow(SEGMENT))], _names(SEGMENT))

    return files.mapInArrow(run, SEGMENT)


def touching(segments: DataFrame, level: int | None = None, **bounds) -> DataFrame:
    """Only segments that a region touches: bounds as of slice_region()."""
    if level is not None:
        segments = segments.where(F.col("level") == level)
    extent = {"x": ("x0", "columns"), "y": ("y0", "rows"), "c": ("c", "samples")}
    for axis, b in bounds.items():
        start, end = b if isinstance(b, tuple) else (b, b + 1) if b is not None else (0, None)
        at, n = (F.col(extent[axis][0]), F.col(extent[axis][1])) if axis in extent else (F.col(axis), F.lit(1))
        segments = segments.where(at + n > (start or 0))
        if end is not None and end >= 0:
            segments = segments.where(at < end)
    return segments


def decode_segments(segments: DataFrame) -> DataFrame:
    """CHUNK rows of the segments that are left; neighbours in a file go to one task, which fetches their byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, read, out = _names(SEGMENT), {}, []
        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = dict(zip(names, values, strict=True))
                if r["image_id"] not in read:
                    read = {r["image_id"]: Ranged(r["image_id"])}
                tile = decode_block(read[r["image_id"]].file.read_at(r["bytes"], r["offset"]), r["compression"], np.dtype(r["dtype"]), (r["rows"], r["columns"], r["samples"]), r["predictor"])
                tile = tile[: r["height"] - r["y0"], : r["width"] - r["x0"]]
                for k in range(tile.shape[2]):
                    v = tile[:, :, k]
                    out.append((r["image_id"], r["level"], r["t"], r["c"] + k, r["z"], r["y0"], r["x0"], *v.shape, v.dtype.name, v.astype(np.float64).ravel()))
                if len(out) >= 16:
                    yield chunk_batch(out)
                    out = []
        if out:
            yield chunk_batch(out)

    return segments.repartitionByRange("image_id", "offset").sortWithinPartitions("image_id", "offset").mapInArrow(run, CHUNK)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _arrow(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
    return [kinds[x.split()[1]] for x in schema.split(", ")]


def chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of CHUNK as one batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_arrow(CHUNK))], _names(CHUNK))


def batched(rows: Iterator[tuple], n: int = 16) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, n)):
        yield chunk_batch(part)


def pnm(data: bytes) -> np.ndarray:
    """height x width x channels of a binary PGM or PPM file."""
    at, words = 0, []
    while len(words) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(data[at:end])
        at = end
    if words[0] not in (b"P5", b"P6"):
        raise ValueError("not a binary PGM or PPM file")
    width, height, top, channels = int(words[1]), int(words[2]), int(words[3]), 3 if words[0] == b"P6" else 1
    return np.frombuffer(data, ">u2" if top > 255 else "u1", width * height * channels, at + 1).reshape(height, width, channels)


def bmp(data: bytes) -> np.ndarray:
    """height x width x channels of an uncompressed BMP file of 8 (gray), 24 or 32 bits."""
    start, header, width, height, _, bits, packed = struct.unpack_from("<4xI I ii HH I", data, 6)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("not an uncompressed BMP file of 8, 24 or 32 bits")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    rows = rows if height < 0 else rows[::-1]
    return rows if bits == 8 else rows[:, :, 2::-1]


def _cut(values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for y in range(0, values.shape[0], TILE):
        for x in range(0, values.shape[1], TILE):
            yield y, x, values[y : y + TILE, x : x + TILE]


def decode(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of CHUNK."""
    if path.lower().endswith((".pgm", ".ppm", ".pnm", ".bmp")):
        image = bmp(data) if path.lower().endswith(".bmp") else pnm(data)
        found = ((0, 0, k, y, x, v) for k in range(image.shape[2]) for y, x, v in _cut(image[:, :, k]))
    else:
        found = ((level, z, c, y + dy, x + dx, v) for level, z, c, y, x, tile in tiff_tiles(data) for dy, dx, v in _cut(tile))
    for level, z, c, y, x, v in found:
        yield path, level, 0, c, z, y, x, *v.shape, v.dtype.name, v.astype(np.float64).ravel()


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Tiles of all images below a path, as CHUNK."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from batched(decode(name, data))

    return files.mapInArrow(run, CHUNK)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any store that Spark reaches, also one whose name Spark's readers pass over; None: it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass
class Array:
    """The metadata of a chunked array, version 2 or 3."""

    shape: list[int]
    chunk: list[int]
    dtype: np.dtype
    codec: str | None
    separator: str
    prefix: str
    layout: str = "C"

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Array":
        if (text := read_text(spark, f"{path}/.zarray")) is not None:
            m = json.loads(text)
            return cls(m["shape"], m["chunks"], np.dtype(m["dtype"]), (m.get("compressor") or {}).get("id"), m.get("dimension_separator", "."), "", m.get("order", "C"))
        if (text := read_text(spark, f"{path}/zarr.json")) is None:
            raise FileNotFoundError(f"no array at {path}")
        m = json.loads(text)
        keys = m.get("chunk_key_encoding", {"name": "default"})
        default = keys["name"] == "default"
        codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
        order = ">" if codecs.get("bytes", {}).get("endian") == "big" else "<"
        packed = [c for c in codecs if c not in ("bytes", "crc32c")]
        return cls(m["shape"], m["chunk_grid"]["configuration"]["chunk_shape"], np.dtype(m["data_type"]).newbyteorder(order), packed[0] if packed else None, keys.get("configuration", {}).get("separator", "/" if default else "."), "c" if default else "")

    def unpack(self, data: bytes) -> np.ndarray:
        if self.codec in ("zlib", "gzip"):
            data = zlib.decompress(data, 47)
        elif self.codec == "zstd":
            import zstandard  # in the library's own dependencies; only such arrays need it

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif self.codec is not None:
            raise ValueError(f"codec {self.codec} isn't installed")
        return np.frombuffer(data, self.dtype, int(np.prod(self.chunk))).reshape(self.chunk, order=self.layout)

    def index(self, name: str) -> list[int]:
        rank = len(self.shape)
        parts = name.rsplit("/", rank)[1:] if self.separator == "/" else name.rsplit("/", 1)[1].removeprefix(f"{self.prefix}.").split(".")
        return [int(k) for k in parts]

    def glob(self) -> str:
        inner = "/".join(["*"] * len(self.shape)) if self.separator == "/" else f"{self.prefix}.*" if self.prefix else "[0-9]*"
        return f"{self.prefix}/{inner}" if self.prefix and self.separator == "/" else inner


def array_store(spark: SparkSession, path: str, level: int = 0, image_id: str | None = None) -> DataFrame:
    """A chunked array folder of version 2 or 3 (raw, zlib, gzip or zstd) as CHUNK. Chunks are files to Spark: one that isn't
    there holds the fill value and has no row."""
    meta = Array.load(spark, path)
    rank, name_of = len(meta.shape), image_id or path
    if rank > 5 or rank < 2:
        raise ValueError(f"arrays of {rank} dimensions are not images")

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        start = [i * c for i, c in zip(meta.index(name), meta.chunk, strict=True)]
        values = meta.unpack(data)[tuple(slice(0, n - s) for n, s in zip(meta.shape, start, strict=True))]
        values, first = values.reshape((1,) * (5 - rank) + values.shape), [0] * (5 - rank) + start
        for t, c, z in np.ndindex(values.shape[:3]):
            v = values[t, c, z]
            yield name_of, level, first[0] + t, first[1] + c, first[2] + z, first[3], first[4], *v.shape, v.dtype.name, v.astype(np.float64).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from batched(rows(name, data))

    return spark.read.format("binaryFile").load(f"{path}/{meta.glob()}").select("path", "content").mapInArrow(run, CHUNK)


def group_attributes(spark: SparkSession, path: str) -> dict | None:
    """The multiscale attributes of a group, version 2 or 3; None: it is no group."""
    if (text := read_text(spark, f"{path}/.zattrs")) is not None and "multiscales" in (found := json.loads(text)):
        return found
    if (text := read_text(spark, f"{path}/zarr.json")) is not None:
        found = json.loads(text).get("attributes", {})
        found = found.get("ome", found)
        return found if "multiscales" in found else None
    return None


def group_metadata(attributes: dict) -> dict:
    """pixel_size and position by axis (value, unit; (1, "") and (0, "") for an axis that isn't there), channels, paths of
    the levels and the scale of each."""
    image = attributes["multiscales"][0]
    axes = [a if isinstance(a, dict) else {"name": a} for a in image.get("axes", list("tczyx"))]
    steps = [{t["type"]: t[t["type"]] for t in d.get("coordinateTransformations", [])} for d in image["datasets"]]
    size, position = {a: (1, "") for a in "xyz"}, {a: (0, "") for a in "xyz"}
    for k, a in enumerate(axes):
        if a["name"] in size:
            unit = a.get("unit", "")
            size[a["name"]] = (steps[0].get("scale", [1] * len(axes))[k], unit)
            position[a["name"]] = (steps[0].get("translation", [0] * len(axes))[k], unit)
    channels = attributes.get("omero", {}).get("channels", [])
    return {"name": image.get("name", ""), "axes": [a["name"] for a in axes], "pixel_size": size, "position": position, "channels": channels, "paths": [d["path"] for d in image["datasets"]], "scales": [s.get("scale") for s in steps]}


def zarr(spark: SparkSession, path: str) -> DataFrame:
    """A group with all its levels, or a single array, as CHUNK."""
    path = path.rstrip("/")
    if (attributes := group_attributes(spark, path)) is None:
        return array_store(spark, path if read_text(spark, f"{path}/.zarray") or read_text(spark, f"{path}/zarr.json") else f"{path}/0", image_id=path)
    out = None
    for level, inner in enumerate(group_metadata(attributes)["paths"]):
        rows = array_store(spark, f"{path}/{inner}", level, path)
        out = rows if out is None else out.unionByName(rows)
    return out


def tiff(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of a TIFF file, by byte ranges; where the store has no such reader, by whole files."""
    try:
        Ranged(path)
    except Exception:  # a store that only Spark reads
        return read(spark, path)
    return decode_segments(tiff_segments(spark, path))


def pixels_of(chunks: DataFrame) -> DataFrame:
    """Long form: image_id, level, t, c, z, y, x, v."""
    rows = chunks.select("image_id", "level", "t", "c", "z", "y0", "x0", "w", F.posexplode("data").alias("k", "v"))
    return rows.select("image_id", "level", "t", "c", "z", (F.col("y0") + F.floor(F.col("k") / F.col("w"))).alias("y"), (F.col("x0") + F.col("k") % F.col("w")).alias("x"), "v")


def catalog(chunks: DataFrame) -> DataFrame:
    """One row per image and level with its sizes and element type."""
    return chunks.groupBy("image_id", "level").agg(F.max(F.col("x0") + F.col("w")).alias("size_x"), F.max(F.col("y0") + F.col("h")).alias("size_y"), (F.max("z") + 1).alias("size_z"), (F.max("c") + 1).alias("size_c"), (F.max("t") + 1).alias("size_t"), F.first("dtype").alias("dtype"))


#: Readers by extension; others register theirs here.
READERS = {".tif": tiff, ".tiff": tiff, ".pgm": read, ".ppm": read, ".pnm": read, ".bmp": read, ".zarr": zarr, ".parquet": lambda spark, path: spark.read.parquet(path)}


def open_image(spark: SparkSession, path: str) -> DataFrame:
    for ending in sorted(READERS, key=len, reverse=True):
        if path.lower().rstrip("/").endswith(ending):
            return READERS[ending](spark, path)
    raise NotImplementedError(f"no reader for {path}")


def pixel_size(page: Page) -> list[tuple[float, str]]:
    """Size and unit along x and y: from the description's numbers, else from the resolution tags."""
    unit = {1: "", 2: "inch", 3: "cm"}.get(page.get("resolution_unit", 2), "")
    text = page.get("description") or ""
    found = {}
    for part in text.replace("\r", "\n").replace("|", "\n").split("\n"):
        key, sep, value = part.partition("=" if "=" in part else ":")
        if sep:
            found[key.strip().lower()] = value.strip()
    for keys in (("pixelwidth", "pixelheight"), ("mpp", "mpp")):
        if all(k in found for k in keys):
            return [(float(found[k]), "µm") for k in keys]
    out = []
    for name in ("x_resolution", "y_resolution"):
        r = page.get(name)
        if r and r[0]:
            out.append((r[1] / r[0], unit))
    return out
