"""SimHash near-duplicates: fingerprints that differ in few bits, found exactly by vantage-point trees.

A tree over a bounded sample of fingerprints deals all of them to shards: each node splits by the Hamming distance to its
vantage point. A fingerprint has one home shard and visits, as a query, each later shard that its search ball reaches by
the triangle bound (so each pair meets once). A task builds a vantage-point tree over a block of one shard and runs the
visitors through it; it returns the links as stars, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import materialize, numpy_components, pieces, small_batches, utf8
from .components import connected

SHINGLE = 3
SEED = 42
BITS = 2
#: The sample that the routing tree is fitted on; rows of a shard and of a block that are aimed at; rows of a local leaf.
SAMPLE, SHARD, BLOCK, LEAF = 1 << 14, 2048, 8192, 48
MIN_DEPTH, MAX_DEPTH = 6, 13


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned; a null text counts as one without words: 0."""
    found = text.lower().split() if text else ()
    n = len(found)
    if not n:
        return 0
    whole = b" ".join(found)
    if n <= shingle:
        return xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    h = np.array([xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and _fp (the fingerprint's 64 bits as a long). A text that is kept goes through Python once."""
    rows = docs.select(*keep, *([] if text in keep else [F.col(text).cast("string")]))
    at, schema = rows.columns.index(text), T.StructType([f for f in rows.schema if f.name != text or text in keep]).add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(t) for t in utf8(b.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema) - 1], pa.array(fp)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _far(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


class Tree:
    """A vantage-point tree; leaves hold positions in `points`. Node: (vantage, radius, inside, outside), leaf: its number."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 64):
        self.points, self.leaves = points, []
        self._rng = np.random.default_rng(7)
        self.root = self._build(np.arange(len(points)), leaf, depth)

    def _build(self, at: np.ndarray, leaf: int, depth: int):
        if len(at) > leaf and depth:
            best = None
            for c in self._rng.choice(at, min(4, len(at)), replace=False):
                far = _far(self.points[at], self.points[c])
                radius = int(np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2])
                for r in (radius, radius - 1):
                    inside = int((far <= r).sum())
                    if 0 < inside < len(at) and (best is None or abs(2 * inside - len(at)) < best[0]):
                        best = abs(2 * inside - len(at)), int(self.points[c]), r, far <= r
            if best:
                _, vantage, radius, inside = best
                return vantage, radius, self._build(at[inside], leaf, depth - 1), self._build(at[~inside], leaf, depth - 1)
        self.leaves.append(at)
        return len(self.leaves) - 1

    def visit(self, queries: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf that balls of radius `reach` around some queries may touch, and the positions of those queries; with
        reach 0 each query comes to the one leaf that it belongs to."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            vantage, radius, inside, outside = node
            far = _far(queries[at], vantage)
            todo.append((inside, at[far - reach <= radius]))
            todo.append((outside, at[far + reach > radius]))

    def near(self, queries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, point) of at most `reach` differing bits."""
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for leaf, at in self.visit(queries, reach):
            own = self.leaves[leaf]
            for k in range(0, len(at), 1 << 14):
                q, p = np.nonzero(np.bitwise_count(queries[at[k : k + (1 << 14)], None] ^ self.points[own][None, :]) <= reach)
                a.append(at[k : k + (1 << 14)][q])
                b.append(own[p])
        return np.concatenate(a), np.concatenate(b)


def _stars(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Links between the fingerprints x and y as stars."""
    nodes, at = np.unique(np.concatenate([x, y]).view(np.int64), return_inverse=True)
    low = nodes[numpy_components(len(nodes), at[: len(x)], at[len(x) :])]
    return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], ["a", "b"])


def links(fps: DataFrame, reach: int = BITS) -> DataFrame:
    """fps: one column fp of distinct longs. Returns a, b: links that connect exactly the fingerprints that chains of at
    most `reach` differing bits connect."""
    spark = fps.sparkSession
    n = fps.count()
    sample = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    depth = min(MAX_DEPTH, max(MIN_DEPTH, math.ceil(math.log2(max(n, 1) / SHARD))))
    routing = spark.sparkContext.broadcast(Tree(np.array(sample, np.int64).view(np.uint64), max(1, SAMPLE >> (MAX_DEPTH + 1)), depth))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, leaf = b.column(0).to_numpy().view(np.uint64), np.zeros(b.num_rows, np.int32)
            for k, at in routing.value.visit(points, 0):
                leaf[at] = k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf)], ["fp", "leaf"])

    # one row per shard of the routing tree comes to the driver; a shard of more rows than a block is split by hash
    sizes = {r["leaf"]: r["count"] for r in fps.mapInArrow(home, "fp long, leaf int").groupBy("leaf").count().collect()}
    blocks = np.array([max(1, -(-sizes.get(k, 0) // BLOCK)) for k in range(len(routing.value.leaves))], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy().view(np.uint64)
            own = np.zeros(len(points), np.int64)
            for k, at in routing.value.visit(points, 0):
                own[at] = k
            mix = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[own]
            for k, at in routing.value.visit(points, reach):
                at = at[own[at] <= k]
                for block in range(blocks[k]):
                    stay = (own[at] < k) | (mix[at] <= block)
                    rows = at[stay]
                    if len(rows):
                        visits = ((own[rows] < k) | (mix[rows] < block)).astype(np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(np.full(len(rows), block, np.int32)), pa.array(visits), pa.array(points[rows].view(np.int64))], ["leaf", "block", "visits", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, tree = None, [], None

        def built() -> Tree:
            return Tree(np.concatenate(own), LEAF)

        def inner(tree: Tree) -> pa.RecordBatch:
            a, b = tree.near(tree.points, reach)
            return _stars(tree.points[a[a < b]], tree.points[b[a < b]])

        for b in batches:
            if not b.num_rows:
                continue
            leaf, block, visits, fp = (c.to_numpy() for c in b.columns)
            cut = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (visits[1:] != visits[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                if (now := (leaf[s], block[s])) != key:
                    if own and tree is None:
                        yield inner(built())
                    key, own, tree = now, [], None
                points = fp[s:e].view(np.uint64)
                if not visits[s]:
                    own.append(points)
                elif own:
                    if tree is None:
                        tree = built()
                        yield inner(tree)
                    x, y = tree.near(points, reach)
                    yield _stars(points[x], tree.points[y])
        if own and tree is None:
            yield inner(built())

    dealt = fps.mapInArrow(deal, "leaf int, block int, visits byte, fp long")
    return dealt.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "visits").mapInArrow(search, "a long, b long")


def _grouped(docs: DataFrame, *keep: str, text: str, key: str, reach: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (keep, key, _fp, _uid), the group's first row (first: none, id, uid) by fingerprint and by group."""
    small_batches(docs.sparkSession)
    rows, _ = materialize(fingerprints(docs, *dict.fromkeys((*keep, key)), text=text).withColumn("_uid", F.monotonically_increasing_id()), "simhash")
    who = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_uid").alias("uid"))
    classes, _ = materialize(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(who).alias("who")), "fingerprints")
    found = connected(links(classes.select("fp"), reach))
    roots = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "who", F.coalesce("component", "fp").alias("root"))
    first = roots.groupBy(F.col("root").alias("r")).agg(F.min("who").alias("first"))
    return rows, roots.join(first, F.col("root") == F.col("r")).select("fp", "first"), first


def near_duplicates(docs: DataFrame, *keep: str, reach: int = BITS) -> DataFrame:
    """The columns `keep` of all documents with _fp, _component (smallest doc_id that links reach) and _first (true for
    one row of each group: the one of smallest doc_id).

    A null text has fingerprint 0 like an empty one. Rows with a null id take part and come last in a group's order; a
    group of nulls alone has a null component. Rows that repeat are copies of each other. An empty table gives none."""
    rows, of, _ = _grouped(docs, *keep, text="text", key="doc_id", reach=reach)
    return rows.join(of, F.col("_fp") == F.col("fp")).withColumn("_component", F.col("first.id")).withColumn("_first", F.col("_uid") == F.col("first.uid")).select(*keep, "_fp", "_component", "_first")


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, "doc_id").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs' own columns: one document of each group of near copies, the one of smallest id (null ids come last; of equal
    ids the first row). Null and empty texts are copies of each other; an empty table stays one. Groups are found from
    keys and fingerprints; texts move once, by the number of their row, so that a large group is no hot key."""
    names = docs.columns
    own = [f"_c{k}" for k in range(len(names))]
    text, key = own[names.index("text")], own[names.index("doc_id")]
    rows, _, first = _grouped(docs.toDF(*own).withColumn(text, F.col(text).cast("string")), *own, text=text, key=key, reach=BITS)
    kept = rows.join(first.select(F.col("first.uid").alias("_kept")), F.col("_uid") == F.col("_kept"), "left_semi")
    return kept.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])
