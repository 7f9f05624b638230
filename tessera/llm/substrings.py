"""Substring dedup: whole texts that repeat, paragraphs that repeat nearly (MinHash banding), passages inside of texts.

Equal texts are one class from the start, and only one of each goes on. A paragraph is a line of MIN_WORDS words or more, or
several shorter lines in a row that have so many together (wrapped text). Its MinHash signature over 5-word shingles falls
into BANDS bands of ROWS rows: two paragraphs of Jaccard 0.8 share a band with probability 1 - (1 - 0.8 ** 3) ** 10 =
0.999. Equal paragraphs are one class. In each bucket all classes are paired with its first one (never with each other),
the pairs are verified by exact Jaccard, and components follow; in buckets in which several components are left, members
outside of the largest one are then compared with all, in blocks, so that no link is lost.

A passage is a run of PASSAGE words or more that stands elsewhere, too. Seeds of SEED words at positions that winnowing
picks (one in every PASSAGE - SEED shingles) find where to look: each repeated run holds a repeated seed. There every
window of PASSAGE words is hashed, and the windows that repeat are merged: what they cover is exactly what repeats.

A text's words are hashed once; shingles, seeds, windows and digests are sums over runs of these hashes (polynomials, by
differences of prefix sums), the longer ones in 128 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import WORD_JAVA, materialize, pieces, release, small_batches, utf8
from .components import connected

SHINGLE, JACCARD = 5, 0.8
MIN_WORDS, BANDS, ROWS = 15, 10, 3
PASSAGE, SEED = 50, 20
WINDOW = PASSAGE - SEED
BLOCK = 1024
#: The bits of a filter that keeps most of what isn't wanted from being moved: 32 for each key, these at least and most.
#: A full filter only keeps more.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Classes of equal texts that are broadcast, 40 bytes each; beyond, they are joined.
MOST_COPIES = 1 << 20
CACHE = 1 << 18
_rng = np.random.default_rng(11)
_A = (_rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_BASES = tuple(int(x) for x in (_rng.integers(1, 1 << 61, 2, dtype=np.uint64) << np.uint64(2)) | np.uint64(1))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.iinfo(np.uint64).max


class _Words(dict):
    """Hashes of words; a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxh64_intdigest(word, 11)
        if len(self) < CACHE:
            self[word] = h
        return h


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    if len(_powers.get(base, ())) <= n:
        x = np.full(max(n + 1, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Texts:
    """Texts side by side: their words' hashes, and where each text and paragraph stands in them."""

    def __init__(self, texts: list[bytes | None], cache: dict[bytes, int]):
        words: list[bytes] = []
        ends, rows, starts, sizes = [], [], [], []
        for k, text in enumerate(texts):
            block = 0  # words of the short lines just before
            for line in text.lower().split(b"\n") if text else ():
                own = line.split()
                n = len(own)
                if n >= MIN_WORDS or not n:
                    if block >= MIN_WORDS:
                        rows.append(k)
                        starts.append(len(words) - block)
                        sizes.append(block)
                    if n:
                        rows.append(k)
                        starts.append(len(words))
                        sizes.append(n)
                    block = 0
                else:
                    block += n
                words += own
            if block >= MIN_WORDS:
                rows.append(k)
                starts.append(len(words) - block)
                sizes.append(block)
            ends.append(len(words))
        n = len(words)
        self.n, self.ends = n, np.array(ends, np.int64)
        self.first = np.concatenate(([0], self.ends[:-1])) if ends else self.ends
        self.row = np.repeat(np.arange(len(texts)), self.ends - self.first)
        self.paragraphs = np.array(rows, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        self._sums = []
        for base, x in zip(_BASES, (h, _mixed(h)), strict=True):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(x * _power(base, n)[:n], out=sums[1:])
            self._sums.append((sums, _power(pow(base, -1, 1 << 64), n)))

    def hashes(self, at: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Of the runs of `size` words from the positions `at`."""
        sums, back = self._sums[which]
        return _mixed((sums[at + size] - sums[at]) * back[at])

    def digests(self, at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.hashes(at, size, k).view(np.int64) for k in range(2))

    def shingles(self) -> np.ndarray:
        """At each position; where the text ends before, the largest number."""
        out = np.full(self.n, _TOP)
        at = np.flatnonzero(np.arange(self.n) + SHINGLE <= self.ends[self.row])
        out[at] = self.hashes(at, SHINGLE)
        return out

    def seeds(self, shingles: np.ndarray) -> np.ndarray:
        """Positions of seeds: smallest in some WINDOW neighbouring shingles, with SEED words of the text after them."""
        at = anchors(shingles)
        return at[at + SEED <= self.ends[self.row[at]]]


def signatures(shingles: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """paragraphs x BANDS, 32 bits each, of paragraphs of `size` words at `at`."""
    low = np.empty((BANDS * ROWS, len(at)), np.uint64)
    if len(at):
        cuts, ended = np.stack([at, at + size - SHINGLE + 1], 1).ravel(), np.append(shingles, _TOP)
        for k in range(BANDS * ROWS):
            low[k] = np.minimum.reduceat(ended * _A[k] + _B[k], cuts)[::2]
    low = low.reshape(BANDS, ROWS, -1)
    mixed = (low[:, 0] * _A[0]) ^ (low[:, 1] * _A[1] >> np.uint64(7)) ^ (low[:, 2] * _A[2] << np.uint64(5))
    return (mixed * _A[3] >> np.uint64(32)).astype(np.uint32).view(np.int32).T


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over each n neighbours."""
    width = 1
    while width * 2 <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Positions that are smallest in some WINDOW neighbouring shingles."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64)
    low = _sliding(hashes, WINDOW, np.minimum)
    zero = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero((_sliding(np.concatenate([zero, low, zero]), WINDOW, np.maximum) == hashes) & (hashes != _TOP))


class Filter:
    """A bit filter with two bits for each key (a long)."""

    def __init__(self, keys: DataFrame, key: str, n: int):
        size = LEAST_BITS
        while size < min(32 * n, MOST_BITS):
            size *= 2
        slots = F.explode(F.array(*[F.shiftrightunsigned(F.col(key), s).bitwiseAND(F.lit(size - 1)) for s in (0, 32)])).alias("s")
        bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))).alias("b")
        found = keys.select(slots).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(bit).toArrow()  # MOST_BITS / 64 rows at most
        self.bits = np.zeros(size // 64, np.uint64)
        self.bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
        self.mask = np.uint64(size - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for s in (0, 32):
            slot = keys.view(np.uint64) >> np.uint64(s) & self.mask
            ok &= (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok


def _id_first(*more: str) -> Column:
    """An order of rows: by id, null ones last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *more)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of doc_id, text: the classes of texts that stand in several rows (x1, x2, first: the smallest id), and one row each of
    every (text, id) in them (x1, x2, doc_id, m: rows)."""
    rows = docs.where(F.col("text").rlike(WORD_JAVA)).groupBy(*[x.alias(f"x{k}") for k, x in enumerate(_digest(), 1)], "doc_id").agg(F.count("*").alias("m"))
    rows, _ = materialize(rows, "substring-texts")
    classes = rows.groupBy("x1", "x2").agg(F.sum("m").alias("n"), F.min(_id_first()).alias("first")).where("n > 1").drop("n")
    classes, _ = materialize(classes, "substring-copies")
    return classes, rows


def _digest() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))


def distinct_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text, x1, x2 (null unless the text has copies): one row of each text."""
    x1, x2 = _digest()
    rows, n = docs.withColumns({"_x1": x1, "_x2": x2}), classes.count()
    of = classes.select("x1", "x2", "first")
    found = rows.join(F.broadcast(of) if n <= MOST_COPIES else of, (F.col("_x1") == F.col("x1")) & (F.col("_x2") == F.col("x2")), "left")
    alone = found.where("x1 is null").select("doc_id", "text", "x1", "x2")
    # rows that repeat with their id are one
    first = found.where(F.col("x1").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first.id")))
    first = first.groupBy("x1", "x2", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "x1", "x2")
    out = alone.unionByName(first)
    return out if n <= MOST_COPIES else materialize(out, "substring-distinct")[0]


UNITS = "doc_id {0}, kind byte, start long, n_words long, h1 long, h2 long, bands array<int>"


def units(docs: DataFrame) -> DataFrame:
    """Of distinct_texts(): rows of three kinds. 0: a paragraph with its digest and bands; 1: a seed (h1; n_words is how
    often a piece of the table holds it); 2: a text with copies (h1, h2: its x1, x2)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in pieces(batches):
            t = Texts(utf8(b.column(1)), cache)
            shingles = t.shingles()
            row, at, size = t.paragraphs
            h1, h2 = t.digests(at, size)
            seeds, n = np.unique(t.hashes(t.seeds(shingles), SEED), return_counts=True)
            copied = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
            m, k, c = len(row), len(seeds), len(copied)
            ids = pa.concat_arrays([b.column(0).take(pa.array(row)), pa.nulls(k, b.column(0).type), b.column(0).take(pa.array(copied))])
            none = np.zeros(k, np.int64)
            x1, x2 = (b.column(j).take(pa.array(copied)).to_numpy(zero_copy_only=False).astype(np.int64) for j in (2, 3))
            bands = signatures(shingles, at, size)
            offsets = np.concatenate((np.arange(m + 1) * BANDS, np.full(k + c, m * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.repeat(np.int8([0, 1, 2]), [m, k, c])),
                    pa.array(np.concatenate([at - t.first[row], none, np.zeros(c, np.int64)])),
                    pa.array(np.concatenate([size, n, (t.ends - t.first)[copied]])),
                    pa.array(np.concatenate([h1, seeds.view(np.int64), x1])),
                    pa.array(np.concatenate([h2, none, x2])),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(bands).ravel())),
                ],
                ["doc_id", "kind", "start", "n_words", "h1", "h2", "bands"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), "x1", "x2").mapInArrow(run, UNITS.format(kind))


def windows(docs: DataFrame, seeds: Filter) -> DataFrame:
    """doc_id, row, pos, h1, h2, again: windows of PASSAGE words that hold a seed of the filter; again: the text holds it before."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, wanted, done = _Words(), shared.value, 0
        for b in pieces(batches):
            t = Texts(utf8(b.column(1)), cache)
            at = t.seeds(t.shingles())
            at = at[wanted.may_hold(t.hashes(at, SEED))]
            near = np.zeros(t.n + 1, np.int64)
            np.add.at(near, np.maximum(at - WINDOW, t.first[t.row[at]]), 1)
            np.add.at(near, at + 1, -1)
            at = np.flatnonzero(np.cumsum(near[:-1]))
            at = at[at + PASSAGE <= t.ends[t.row[at]]]
            if len(at):
                h1, h2 = t.digests(at, PASSAGE)
                row = t.row[at]
                order = np.lexsort((at, h2, h1, row))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (row[order][1:] == row[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                for lo in range(0, len(at), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[s])), pa.array(done + row[s]), pa.array(at[s] - t.first[row[s]]), pa.array(h1[s]), pa.array(h2[s]), pa.array(again[s])], ["doc_id", "row", "pos", "h1", "h2", "again"])
            done += b.num_rows

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, row long, pos long, h1 long, h2 long, again boolean")
    return found.withColumn("row", F.spark_partition_id().cast("long") * (1 << 33) + F.col("row"))


def passages(docs: DataFrame, seeds: Filter) -> DataFrame:
    """doc_id, start, n_words, cluster_doc, kept: what windows that repeat cover, in runs of one cluster_doc (the smallest id
    with the window; null if all are). Documents of one id count as one; of documents without an id each is one."""
    rows, path = materialize(windows(docs, seeds), "substring-windows")
    of = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.min("row").alias("lo_row")).where("n > 1").drop("n")
    # written, so that the join may split a window that very many documents hold
    of, counted = materialize(of, "substring-repeats")
    found = rows.join(of, ["h1", "h2"])
    first = F.when(F.col("lo").isNull(), F.col("row") == F.col("lo_row")).otherwise(F.col("doc_id").eqNullSafe(F.col("lo"))) & ~F.col("again")
    text = Window.partitionBy("row").orderBy("pos")
    found = found.select("doc_id", "row", "pos", "lo", first.alias("kept"))
    same = F.lag("kept").over(text).eqNullSafe(F.col("kept")) & F.lag("lo").over(text).eqNullSafe(F.col("lo")) & (F.col("pos") <= F.lag("pos").over(text) + PASSAGE)
    runs = found.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(text))
    spans = runs.groupBy("row", "run").agg(F.min("doc_id").alias("doc_id"), F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + PASSAGE).alias("n_words"), F.min("lo").alias("cluster_doc"), F.min("kept").alias("kept"))
    out, _ = materialize(spans.select("doc_id", "start", "n_words", "cluster_doc", "kept"), "substring-passages")
    release(path, counted)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, shingles (a sorted array) of the paragraphs in wanted (h1, h2), from the whole texts again; a filter keeps
    most others from being moved, the join then leaves exactly those wanted. A paragraph that repeats leaves a piece of the
    table once."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(wanted, "h1", wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, wanted = _Words(), shared.value
        for b in pieces(batches):
            t = Texts(utf8(b.column(0)), cache)
            _, at, size = t.paragraphs
            h1, h2 = t.digests(at, size)
            may = np.flatnonzero(wanted.may_hold(h1))
            may = may[np.unique(np.stack([h1[may], h2[may]]), axis=1, return_index=True)[1]] if len(may) else may
            shingles = t.shingles() if len(may) else None
            sets = [np.unique(shingles[s:e]).view(np.int64) for s, e in zip(at[may].tolist(), (at[may] + size[may] - SHINGLE + 1).tolist(), strict=True)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h1[may]), pa.array(h2[may]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["h1", "h2", "shingles"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, shingles array<long>")
    return found.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles")).join(wanted, ["h1", "h2"], "left_semi")


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _verified(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, sa, sb) whose shingles reach the Jaccard threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ok = [jaccard(set(x), set(y)) >= JACCARD for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _block_links(ids: list[int], parts: list[int], odd: list[bool], sets: list[list[int]]) -> list[tuple[int, int]]:
    """Links between members of different components: of the odd ones with the others of the block pair."""
    sizes = np.array([len(s) for s in sets])
    holders: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(sets):
        if odd[k]:
            for x in s:
                holders[x].append(k)
    root = {p: p for p in parts}

    def part(p: int) -> int:
        while root[p] != p:
            p = root[p]
        return p

    out = []
    for k, s in enumerate(sets):
        held = [holders[x] for x in s if x in holders]
        if not held:
            continue
        both = np.bincount(np.concatenate(held), minlength=len(sets))
        for j in np.flatnonzero((both > 0) & (both >= JACCARD * (sizes + sizes[k] - both))).tolist():
            p, q = part(parts[j]), part(parts[k])
            if p != q:
                out.append((ids[j], ids[k]))
                root[p] = q
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of rows sorted by band, value, i, j (then cid, component, odd, shingles): block pair after block pair, many of
    them small, without a call for each."""
    key, rows, found = None, [], []

    def ended() -> None:
        if len(rows) > 1:
            found.extend(_block_links(*map(list, zip(*rows, strict=True))))

    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for now, row in zip(zip(*columns[:4], strict=True), zip(*columns[4:], strict=True), strict=True):
            if now != key:
                ended()
                key, rows = now, []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])
        found.clear()
    ended()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])


def _left_over(inside: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame | None:
    """a, b: links in buckets that hold several components (None if no bucket does). All have been compared with the first
    one, which is left out. Members of a bucket's largest component are compared only with the odd ones outside of it, and
    these with each other: by pairs of blocks, so that a bucket's largest part moves as often as it has blocks of odd
    members."""
    placed = inside.where("cid <> first").join(parts, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    sizes = placed.groupBy("band", "value", "component").agg(F.count("*").alias("k"))
    buckets = sizes.groupBy("band", "value").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    buckets = buckets.select("band", "value", F.col("top.component").alias("top"), F.ceil((F.col("n") - F.col("top.k")) / BLOCK).cast("int").alias("odds"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("mains"))
    buckets, _ = materialize(buckets, "substring-open")
    if buckets.isEmpty():
        return None
    left = placed.select("band", "value", "cid", "component").join(buckets, ["band", "value"])
    odd = F.col("component") != F.col("top")
    own = F.when(odd, F.pmod(F.xxhash64("cid"), F.col("odds"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("mains"))).cast("int")
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    # i: the block of odd members; j: the one they meet, odd ones (up to their own) as -1 - j
    meet_odd = F.transform(steps(F.col("odds")), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), (-1 - F.greatest(o, F.col("own"))).alias("j")))
    meet_main = F.transform(steps(F.col("mains")), lambda o: F.struct(F.col("own").alias("i"), o.alias("j")))
    come_main = F.transform(steps(F.col("odds")), lambda o: F.struct(o.alias("i"), F.col("own").alias("j")))
    left = left.withColumns({"odd": odd, "own": own})
    left = left.select("band", "value", "cid", "component", "odd", F.explode(F.when(F.col("odd"), F.concat(meet_odd, meet_main)).otherwise(come_main)).alias("at"))
    left = left.select("band", "value", "at.i", "at.j", "cid", "component", "odd").join(found, "cid")
    keys = ["band", "value", "i", "j"]
    return left.select(*keys, "cid", "component", "odd", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked, "a long, b long")


def _near(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component of the paragraph classes (cid) that are near-duplicates of another one."""
    members = classes.select("cid", F.posexplode("bands").alias("band", "value"))
    buckets, p1 = materialize(members.groupBy("band", "value").agg(F.min("cid").alias("first"), F.count("*").alias("n")).where("n > 1"), "substring-buckets")
    inside, p2 = materialize(members.join(buckets, ["band", "value"]).select("band", "value", "cid", "first"), "substring-members")
    release(p1)
    stars = inside.where("cid <> first").select(F.col("cid").alias("a"), F.col("first").alias("b")).distinct()
    wanted, p3 = materialize(inside.select("cid").distinct().join(classes.select("cid", "h1", "h2"), "cid"), "substring-wanted")
    found, p4 = materialize(sets_of(docs, wanted.select("h1", "h2")).join(wanted, ["h1", "h2"]).select("cid", "shingles"), "substring-sets")
    of = lambda key, to: found.select(F.col("cid").alias(f"_{key}"), F.col("shingles").alias(to))
    pairs = stars.join(of("a", "sa"), F.col("a") == F.col("_a")).join(of("b", "sb"), F.col("b") == F.col("_b"))
    links, p5 = materialize(_verified(pairs), "substring-links")
    parts, _ = materialize(connected(links), "substring-parts")
    if (more := _left_over(inside, parts, found)) is not None:
        more, p6 = materialize(more, "substring-more")
        if not more.isEmpty():
            parts, _ = materialize(connected(links.unionByName(more)), "substring-parts")
        release(p6)
    release(p2, p3, p4, p5)
    return parts


def repeated(docs: DataFrame) -> DataFrame:
    """One row per repeated unit of a document: doc_id, unit ("text", "paragraph", "passage"), start and n_words (positions
    of words), cluster_doc (the smallest doc_id with a unit of the cluster), cluster_start (that unit's start there; null for
    passages) and kept (this is the occurrence that stays).

    A text that stands in several rows is one unit, which has a row for each of them; only its first document's paragraphs
    and passages are looked at. Texts that repeat nothing have no row. A null text, or one without words, has no units;
    null ids take part and come last; a row that repeats is a copy, of which one is kept; a paragraph that repeats inside of
    one document is kept at its first place; an empty table gives no rows. Texts are read whole, however long."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    classes, whole = copies(docs)
    docs = distinct_texts(docs, classes)
    rows, _ = materialize(units(docs).withColumn("_uid", F.monotonically_increasing_id()), "substring-units")
    seeds, p1 = materialize(rows.where("kind = 1").groupBy("h1").agg(F.sum("n_words").alias("n")).where("n > 1").select("h1"), "substring-seeds")
    parts = passages(docs, Filter(seeds, "h1", seeds.count()))
    release(p1)
    # texts
    sizes = rows.where("kind = 2").select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), "n_words")
    texts = whole.join(classes, ["x1", "x2"]).join(sizes, ["x1", "x2"]).select("doc_id", "n_words", F.col("first.id").alias("cluster_doc"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("k"))
    texts = texts.select("doc_id", F.lit("text").alias("unit"), F.lit(0).cast("long").alias("start"), "n_words", "cluster_doc", F.lit(0).cast("long").alias("cluster_start"), (F.col("doc_id").eqNullSafe(F.col("cluster_doc")) & (F.col("k") == 1)).alias("kept"))
    # paragraphs
    rows = rows.where("kind = 0")
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_id_first("start", "_uid")).alias("who"), F.first("bands").alias("bands"))
    groups, _ = materialize(groups.withColumn("cid", F.monotonically_increasing_id()), "substring-classes")
    near = _near(groups, docs)
    kept = groups.join(near, F.col("cid") == F.col("node"), "left").where("n > 1 or node is not null").select("h1", "h2", "who", F.coalesce("component", "cid").alias("cluster"))
    first = kept.groupBy(F.col("cluster").alias("_c")).agg(F.min("who").alias("first"))
    kept = kept.join(first, F.col("cluster") == F.col("_c")).select("h1", "h2", "first")
    found = rows.select("doc_id", "start", "n_words", "h1", "h2", "_uid").join(kept, ["h1", "h2"])
    found = found.select("doc_id", F.lit("paragraph").alias("unit"), "start", "n_words", F.col("first.id").alias("cluster_doc"), F.col("first.start").alias("cluster_start"), (F.col("_uid") == F.col("first._uid")).alias("kept"))
    inner = parts.select("doc_id", F.lit("passage").alias("unit"), "start", "n_words", "cluster_doc", F.lit(None).cast("long").alias("cluster_start"), "kept")
    return texts.unionByName(found).unionByName(inner)
