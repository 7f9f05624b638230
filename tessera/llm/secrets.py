"""Secret scans with a recursive decoding worklist: escaped, base64 and compressed layers are unwrapped until nothing new
comes up, each layer is scanned, and what it holds is mapped back to the code points of the text.

What bytes hold counts as a layer where they make up READABLE or more printable characters in a row, at any of the four
alignments of a base64 token, so that text glued to the token or junk around the layer doesn't hide it. A token may be
wrapped in lines. Compressed streams are unpacked PIECE bytes at a time, so that the size of a layer costs no memory."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};", re.ASCII)
_ALPHABET = "A-Za-z0-9+/_-"
#: A token; its lines may be broken, also by escaped line ends.
_BASE64 = re.compile(rf"[{_ALPHABET}]{{16,}}(?:(?:\r?\n[\x20\t]*|\\r\\n|\\n)[{_ALPHABET}]{{4,}})*={{0,2}}")
_BREAK = re.compile(r"\r?\n[\x20\t]*|\\r\\n|\\n")
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
READABLE = 8
#: Runs of printable characters in UTF-8.
_PRINTABLE = re.compile(
    rb"(?:[\x09\x0a\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){%d,}+" % READABLE
)
#: How compressed streams start (gzip, bzip2, xz, Zstandard, zlib).
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
#: Bytes unpacked at a time; how far pieces overlap; the longest run without white space that is kept whole; how deep
#: streams inside of streams are opened.
PIECE, OVERLAP, RUN, DEPTH = 1 << 22, 1 << 10, 1 << 24, 32


@dataclass(frozen=True)
class Layer:
    """A decoded text; its character i comes from code points starts[i] to ends[i] of the original, or all of it from the
    code points `whole` (what was compressed). None of these: the original."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    whole: tuple[int, int] | None = None

    def span(self, s: int, e: int) -> tuple[int, int]:
        return self.whole or ((s, e) if self.starts is None else (int(self.starts[s]), int(self.ends[e - 1])))

    def inner(self, text: str, starts: np.ndarray, ends: np.ndarray) -> "Layer":
        """A layer whose characters come from characters starts to ends (exclusive) of this one."""
        if self.whole:
            return Layer(text, whole=self.whole)
        if self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(text, starts, ends)

    def key(self) -> bytes:
        """Equal for layers of equal text that come from the same places."""
        places = repr(self.whole).encode() if self.starts is None else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest() + hashlib.sha256(places).digest()


def scan(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end; leftmost and non-overlapping in each kind, sorted."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by its decoded characters; decode gives (character, start, end) or None."""
    text, last = layer.text, 0
    parts, starts, ends = [], [], []

    def copied(s: int, e: int) -> None:
        parts.append(text[s:e])
        starts.append(np.arange(s, e))
        ends.append(np.arange(s + 1, e + 1))

    for m in pattern.finditer(text):
        chars = decode(m.group())
        if chars is None:
            continue
        copied(last, m.start())
        parts.append("".join(c for c, _, _ in chars))
        starts.append(m.start() + np.array([s for _, s, _ in chars]))
        ends.append(m.start() + np.array([e for _, _, e in chars]))
        last = m.end()
    if not last:
        return None
    copied(last, len(text))
    return layer.inner("".join(parts), np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))


def _percent(run: str):
    """Bytes that are no UTF-8 stay as they are."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    at, out = 0, []
    for c in text:
        if "\udc80" <= c <= "\udcff":
            out += [(run[at + k], at + k, at + k + 1) for k in range(3)]
            at += 3
            continue
        n = 3 * len(c.encode())
        out.append((c, at, at + n))
        at += n
    return out if any(e - s > 1 for _, s, e in out) else None


def _escape(run: str):
    """Lone surrogates stay as they are."""
    if run.startswith("\\u") and run[2] != "{":
        text = bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
        at, out = 0, []
        for c in text:
            n = 6 * (1 + (ord(c) > 0xFFFF))
            out += [(run[k], k, k + 1) for k in range(at, at + n)] if "\ud800" <= c <= "\udfff" else [(c, at, at + n)]
            at += n
        return out if any(e - s > 1 for _, s, e in out) else None
    digits = run.strip("\\uUx{}&#X;")
    point = int(digits, 10 if run.startswith("&#") and run[2] not in "xX" else 16)
    return None if point > 0x10FFFF or 0xD800 <= point < 0xE000 else [(chr(point), 0, len(run))]


class _Source:
    """Pieces of bytes as a file."""

    def __init__(self, data: Iterator[bytes]):
        self.data, self.rest = data, b""

    def read(self, n: int = -1) -> bytes:
        if not self.rest:
            self.rest = next(self.data, b"")
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _unpacked(start: bytes, data: Iterator[bytes], used: list[int] | None = None) -> Iterator[bytes]:
    """What a stream that begins with `start` unpacks to, PIECE bytes at most at a time; a broken one as far as it goes.
    used: gets how many bytes the stream took, where its format tells."""
    fed = 0
    try:
        if start[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=1 << 26).stream_reader(_Source(data)) as r:
                while out := r.read(PIECE):
                    yield out
            return
        if start[:3] == b"BZh":
            d, more = bz2.BZ2Decompressor(), lambda: not d.eof and not d.needs_input and b""
        elif start[:1] == b"\xfd":
            d, more = lzma.LZMADecompressor(memlimit=1 << 27), lambda: not d.eof and not d.needs_input and b""
        else:
            d, more = zlib.decompressobj(47), lambda: d.unconsumed_tail or False
        for part in data:
            fed += len(part)
            out = d.decompress(part, PIECE)
            while True:
                if out:
                    yield out
                if (rest := more()) is False:
                    break
                out = d.decompress(rest, PIECE)
            if d.eof:
                if used is not None:
                    used.append(fed - len(d.unused_data))
                return
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _sliced(data: bytes) -> Iterator[bytes]:
    return (data[k : k + (1 << 16)] for k in range(0, len(data), 1 << 16))


def _runs(data: Iterator[bytes], closed: list[int], above: tuple[bytes, ...] = ()) -> Iterator[str]:
    """Readable runs of an unpacked stream; streams that it is or holds at its start are unpacked in turn, unless one begins
    like a stream around it (a cycle)."""
    rest = b""
    first = True
    for part in data:
        if first:
            first, digest = False, hashlib.sha256(part).digest()
            if digest in above:
                return
            if _MAGIC.match(part):
                if len(above) >= DEPTH:
                    closed[0] += 1
                    return

                def whole(part=part) -> Iterator[bytes]:
                    yield from _sliced(part)
                    yield from data

                yield from _runs(_unpacked(part, whole()), closed, (*above, digest))
                # a stream that wasn't one is text, if it is all here
                if len(part) >= PIECE:
                    return
        rest += part
        if len(rest) < PIECE:
            continue
        cut = max(rest.rfind(c) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut <= 0:
            if len(rest) < RUN:
                continue
            closed[0] += 1  # what stands across this cut isn't seen
            cut = len(rest)
        for m in _PRINTABLE.finditer(rest, 0, cut):
            yield m.group().decode()
        back = max(0, cut - OVERLAP)
        rest = rest[max(back, *(rest.rfind(c, 0, back) for c in (b" ", b"\n"))) if cut < len(rest) else cut :]
    for m in _PRINTABLE.finditer(rest):
        yield m.group().decode()


def _opened(body: str) -> list[tuple[int, int, str | bytes]]:
    """What a token's letters hold at each alignment: (alignment, first byte, readable text or compressed bytes)."""
    body, out = body.replace("-", "+").replace("_", "/"), []
    for shift in range(min(4, len(body))):
        part = body[shift:]
        if len(part) % 4 == 1:
            part = part[:-1]
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        out += [(shift, m.start(), data[m.start() :]) for m in _MAGIC.finditer(data)]
        out += [(shift, m.start(), m.group().decode()) for m in _PRINTABLE.finditer(data)]
    return out


def _layers(layer: Layer, opened: dict[str, list], closed: list[int]) -> Iterator[Layer]:
    """The layers directly inside; opened keeps what each token holds, closed[0] counts layers that stayed closed."""
    text = layer.text
    if "%" in text and (x := _rewritten(layer, _PERCENT, _percent)):
        yield x
    if ("\\" in text or "&#" in text) and (x := _rewritten(layer, _ESCAPE, _escape)):
        yield x
    for m in _BASE64.finditer(text):
        token = m.group().rstrip("=")
        breaks = [(b.start(), b.end()) for b in _BREAK.finditer(token)]
        body = _BREAK.sub("", token) if breaks else token
        if body not in opened:
            opened[body] = _opened(body)
        found = opened[body]
        if not found:
            continue
        where = None
        for shift, first, inner in found:
            if where is None:
                kept = np.ones(len(token), bool)
                for s, e in breaks:
                    kept[s:e] = False
                where = m.start() + np.flatnonzero(kept)
            if isinstance(inner, bytes):  # from a compressed stream all comes from all
                s, used = int(where[first * 8 // 6 + shift]), []
                if breaks:  # the next line may be none of its
                    for _ in _unpacked(inner, _sliced(inner), used):
                        pass
                e = int(where[min((first + used[0]) * 8 // 6 + shift, len(where) - 1)]) + 1 if used else m.end()
                place = layer.span(s, e)
                yield from (Layer(x, whole=place) for x in _runs(_unpacked(inner, _sliced(inner)), closed, (hashlib.sha256(inner).digest(),)))
                continue
            if layer.whole:
                yield Layer(inner, whole=layer.whole)
                continue
            points = np.frombuffer(inner.encode("utf-32-le"), np.uint32)
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            ends = first + np.cumsum(width)
            # a byte starts in sextet 8b / 6 and ends in sextet (8b + 7) / 6
            s, e = (ends - width) * 8 // 6 + shift, np.minimum((ends * 8 - 1) // 6 + shift, len(where) - 1)
            yield layer.inner(inner, where[s], where[e] + 1)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int, int]:
    """Base spans of a whole text, all spans, number of decoded layers (pieces of a large one each), number of layers that
    stayed closed."""
    text = text or ""
    base = scan(text)
    every, seen, opened, n, closed = set(base), set(), {}, 0, [0]
    work = [_layers(Layer(text), opened, closed)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        # the same text at another place has spans of its own; from the same place it would only come up again, which ends
        # cycles: a layer is shorter than the one around it unless it was compressed, and then it keeps its place
        elif (key := layer.key()) not in seen:
            seen.add(key)
            n += 1
            for s, kind, e in scan(layer.text):
                s, e = layer.span(s, e)
                every.add((s, kind, e))
            work.append(_layers(layer, opened, closed))
    return base, every, n, closed[0]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with all spans, overlapping ones together, replaced by the mark; null stays null."""
    spans = sorted(find(text)[1]) if text else []
    out, last = [], 0
    for s, _, e in spans:
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, e)
    return text if not spans else "".join(out) + text[last:]


def scan_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of every row with n_assign, n_access, n_hex, base_sha256, spans, n_layers and n_unopened.

    Each row is scanned on its own, whole; a null text counts as empty, repeated rows give repeated results and an empty
    table none. A token is decoded once a text, and each of its places has its own spans and counts in n_layers."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema
    for c, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_layers", "long"), ("n_unopened", "long")):
        schema = schema.add(c, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [[] for _ in range(7)]
            for text in b.column(b.num_columns - 1).to_pylist():
                base, every, n, closed = find(text)
                kinds = [k for _, k, _ in base]
                for column, value in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), n, closed), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def masked_documents(docs: DataFrame) -> DataFrame:
    """docs' own columns; secrets are masked in text, and n_chars follows where there is such a column.

    Null and empty texts stay as they are, repeated rows are masked alike, an empty table gives none. Rows go through
    Python once and only their text is looked at."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    rows = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = pa.array([masked(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    out = rows.mapInArrow(run, rows.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
