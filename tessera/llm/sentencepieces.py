"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

Pieces come from a public model file; their log scores follow Zipf's law in the file's order of ranks. No piece goes on
after a white-space marker that isn't at its start, so a text falls into units (markers and what follows) that are
segmented on their own: a task segments its distinct units, many at once in numpy, and keeps them in a bounded cache.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, small_batches, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Stands for a literal marker in the text; no UTF-8 text holds this byte. It is encoded by its three bytes.
LITERAL = 0xFF
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 300_000
#: Cells of the tables of units that are segmented side by side, 12 bytes each.
TABLE = 1 << 21
_UNK, _PENALTY = -1, 10.0


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """Number, wire type and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, kind, value


def read_pieces(path: str) -> list[tuple[bytes, int]]:
    """Piece and kind in the order of ids."""
    out = []
    with open(path, "rb") as f:
        for number, _, value in fields(f.read()):
            if number == 1:
                piece, kind = b"", NORMAL
                for n, _, v in fields(value):
                    piece, kind = (v, kind) if n == 1 else (piece, v) if n == 3 else (piece, kind)
                out.append((piece, kind))
    return out


def zipf_scores(pieces: list[tuple[bytes, int]]) -> np.ndarray:
    normal = [k for k, (_, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
    scores = np.zeros(len(pieces), np.float32)
    ranks = np.arange(1, len(normal) + 1, dtype=np.float64)
    scores[normal] = -np.log(ranks * (1 / ranks).sum())
    return scores


class DoubleArray:
    """base, check and value of a trie over bytes: the child of s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        base, check, value = [0] * 258, [-2] + [-1] * 257, [-1] * 258
        # nodes with one child fill the gaps from `gap` on; the others are set from `fresh` on, which moves up with them
        gap, fresh, todo = 257, 257, [(0, 0, 0, len(keys))]
        while todo:
            node, depth, lo, hi = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                value[node] = keys[lo][1]
                lo += 1
            if lo >= hi:
                continue
            groups, start = [], lo
            for k in range(lo + 1, hi + 1):
                if k == hi or keys[k][0][depth] != keys[start][0][depth]:
                    groups.append((keys[start][0][depth] + 1, start, k))
                    start = k
            first = groups[0][0]
            at = max(gap, first) if len(groups) == 1 else max(fresh, first)
            while True:
                while len(check) < at + 600:
                    base.append(0)
                    check.append(-1)
                    value.append(-1)
                if all(check[at - first + code] == -1 for code, _, _ in groups):
                    break
                at += 1
            if len(groups) > 1:
                fresh = max(fresh, at - 64)
            base[node] = at - first
            for code, s, e in groups:
                check[at - first + code] = node
                todo.append((at - first + code, depth + 1, s, e))
            while gap < len(check) and check[gap] != -1:
                gap += 1
        self.base, self.check, self.value = (np.array(x + [fill] * 600, np.int32) for x, fill in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """An encoder and decoder; scores: a log score for each id."""

    def __init__(self, pieces: list[tuple[bytes, int]], scores: np.ndarray):
        normal = [(p, k) for k, (p, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        if any(MARK in p.lstrip(MARK) and not p.replace(MARK, b"") == b"" and re.search(rb"[^\xe2\x96\x81]\xe2\x96\x81", p) for p, _ in normal):
            raise ValueError("a piece has a white-space marker inside")
        self.trie = DoubleArray(normal)
        self.scores = scores.astype(np.float32)
        self.unknown = np.float32(min(float(self.scores[k]) for _, k in normal) - _PENALTY)
        self.bytes = np.full(256, -1, np.int32)
        self.text: list[bytes] = []
        for k, (p, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = k
                self.text.append(bytes([int(p[3:5], 16)]))
            else:
                self.text.append(p.replace(MARK, b" ") if kind in (NORMAL, USER) else b"")
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback")
        self._literal = self.bytes[list(MARK)].tobytes()
        lines = any(b"\n" in p for p, _ in normal)  # a line end that no piece holds is a border of units, too
        self._unit = re.compile(rb" +[^ ]*|[^ ]+" if lines else rb" +[^ \n]*|\n+|[^ \n]+")
        self._cache: dict[bytes, bytes] = {}

    def segment(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as the bytes of 32-bit integers."""
        out: list[bytes] = [b""] * len(units)
        ready = [u.replace(b" ", MARK) for u in units]
        by: dict[int, list[int]] = {}
        for k, u in enumerate(ready):
            by.setdefault(len(u), []).append(k)
        for n, at in by.items():
            step = max(1, TABLE // (n + 1))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                for k, ids in zip(part, self._alone([ready[k] for k in part]) if len(part) < 3 and n > 24 else self._many([ready[k] for k in part], n), strict=True):
                    out[k] = ids
        return out

    def _many(self, units: list[bytes], n: int) -> list[bytes]:
        m, data = len(units), np.frombuffer(b"".join(units), np.uint8).reshape(len(units), n)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best = np.full((m, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        start, piece = np.zeros((m, n + 1), np.int32), np.zeros((m, n + 1), np.int32)
        width = np.where(data < 0xC0, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, np.where(data < 0xF8, 4, 1))))
        for s in range(n):
            live = np.flatnonzero(best[:, s] > -np.inf)
            rows, node, single = live, np.zeros(len(live), np.int32), np.zeros(m, bool)
            for e in range(s + 1, n + 1):
                to = base[node] + data[rows, e - 1] + 1
                ok = check[to] == node
                rows, node = rows[ok], to[ok]
                if not len(rows):
                    break
                hit = value[node] >= 0
                if hit.any():
                    r, v = rows[hit], value[node[hit]]
                    single[r[width[r, s] == e - s]] = True
                    score = best[r, s] + self.scores[v]
                    up = score > best[r, e]
                    r, v = r[up], v[up]
                    best[r, e], start[r, e], piece[r, e] = score[up], s, v
            r = live[~single[live]]
            if len(r):
                e = np.minimum(s + width[r, s], n)
                score = best[r, s] + self.unknown
                up = score > best[r, e]
                r, e = r[up], e[up]
                best[r, e], start[r, e], piece[r, e] = score[up], s, _UNK
        rows, at, steps = np.arange(m), np.full(m, n), []
        while len(rows):
            steps.append((rows, piece[rows, at], start[rows, at], at))
            at = start[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        steps.reverse()
        order = np.argsort(np.concatenate([x[0] for x in steps]), kind="stable")
        row, ids, lo, hi = (np.concatenate([x[k] for x in steps])[order] for k in range(4))
        ends = np.cumsum(np.bincount(row, minlength=m))
        odd = set(row[ids == _UNK].tolist())
        flat = ids.astype(np.int32)
        return [self._with_bytes(units[k], zip(ids[s:e].tolist(), lo[s:e].tolist(), hi[s:e].tolist(), strict=True)) if k in odd else flat[s:e].tobytes() for k, (s, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))]

    def _alone(self, units: list[bytes]) -> list[bytes]:
        """The same for few long units, without numpy's cost per step."""
        base, check, value, scores = (memoryview(x) for x in (self.trie.base, self.trie.check, self.trie.value, self.scores))
        out = []
        for u in units:
            n = len(u)
            best, back = [None] * (n + 1), [None] * (n + 1)
            best[0] = np.float32(0)
            for s in range(n):
                if best[s] is None:
                    continue
                lead = u[s]
                width, node, single = 1 if lead < 0xC0 or lead >= 0xF8 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, 0, False
                for e in range(s + 1, n + 1):
                    to = base[node] + u[e - 1] + 1
                    if check[to] != node:
                        break
                    node = to
                    if (v := value[node]) >= 0:
                        single |= e - s == width
                        score = best[s] + np.float32(scores[v])
                        if best[e] is None or score > best[e]:
                            best[e], back[e] = score, (v, s, e)
                if not single:
                    e, score = min(s + width, n), best[s] + self.unknown
                    if best[e] is None or score > best[e]:
                        best[e], back[e] = score, (_UNK, s, e)
            at, steps = n, []
            while at:
                steps.append(back[at])
                at = back[at][1]
            out.append(self._with_bytes(u, reversed(steps)))
        return out

    def _with_bytes(self, unit: bytes, steps) -> bytes:
        parts = []
        for v, s, e in steps:
            if v != _UNK:
                parts.append(np.int32(v).tobytes())
            elif unit[s] == LITERAL:
                parts.append(self._literal)
            else:
                parts.append(self.bytes[list(unit[s:e])].tobytes())
        return b"".join(parts)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers. A text with words gets one marker in front."""
        split = [self._unit.findall(b" " + t.replace(MARK, b"\xff")) if t else [] for t in texts]
        new = list(set().union(*split).difference(self._cache)) if split else []
        if len(self._cache) + len(new) > CACHE:
            self._cache.clear()
            new = list(set().union(*split))
        self._cache.update(zip(new, self.segment(new), strict=True))
        return [b"".join(map(self._cache.__getitem__, units)) for units in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))[1:]


def load(path: str = MODEL) -> Pieces:
    pieces = read_pieces(path)
    return Pieces(pieces, zipf_scores(pieces))


def encode_documents(docs: DataFrame, *keep: str, model: str = MODEL) -> DataFrame:
    """The columns `keep` of every row with ids (array of int), n_tokens, n_byte_tokens and round_trip (the decoded ids give
    the whole text back).

    A null text gives null ids, 0 tokens and true; an empty one empty ids. Rows are encoded each on its own. The model
    file is read on the driver and broadcast; its size doesn't depend on the data."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("n_byte_tokens", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder: Pieces = shared.value
        is_byte = np.zeros(len(coder.text), bool)
        is_byte[coder.bytes] = True
        for b in pieces(batches):
            texts = utf8(b.column(b.num_columns - 1))
            found = coder.encode([t or b"" for t in texts])
            flat = np.frombuffer(b"".join(found), np.int32)
            n = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
            ends = np.concatenate(([0], np.cumsum(n)))
            bytewise = np.concatenate(([0], np.cumsum(is_byte[flat])))
            ok = [coder.decode(flat[s:e].tolist()) == (t or b"") for t, s, e in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array(n), pa.array(bytewise[ends[1:]] - bytewise[ends[:-1]]), pa.array(ok, pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)
