"""Embedding near-duplicates: all pairs over a cosine threshold by cover trees and dual traversal.

On the unit sphere cosine >= t is distance <= sqrt(2 - 2t). A cover tree (nested nets with halving radii) over a bounded
sample gives cells; every vector joins the cell of its nearest leaf, and Spark takes the covering radius of each cell over
all its vectors. A dual traversal from (root, root) prunes node pairs that lie farther apart than both radii and the
threshold; what is left are pairs of cells that tasks compare, block by block, each again with cover trees over both
sides. A task returns counts and stars, never all pairs of a dense group, so the output is linear in the vectors it got.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numpy_components
from .components import connected

THRESHOLD = 0.9
#: The sample that the routing tree is fitted on, its most leaves; rows of a block; leaves of a local tree; cells of a product.
SAMPLE, CELLS, BLOCK, LOCAL, PRODUCT = 1 << 13, 1024, 2048, 32, 1 << 22
#: Of bounds, for rounding: near 0 the root of 2 - 2 cos is off by up to 5e-8 in each distance. The comparison itself has none.
_SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; rows are scaled first so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nested nets of `points` (unit rows) in farthest-first order, up to `most` leaves.

    Level k holds the first points that keep all others within 2 / 2 ** k; a node's parent is the nearest node of the level
    above. assign() gives each row its leaf; radii() carries leaf radii up, so that a node's ball covers all below it."""

    def __init__(self, points: np.ndarray, most: int):
        order, reach = [0], _apart(points, points[:1])[:, 0]
        widths = [2.0]
        while len(order) < min(most, len(points)):
            far = int(np.argmax(reach))
            if reach[far] <= 1e-9:
                break
            order.append(far)
            widths.append(float(reach[far]))
            reach = np.minimum(reach, _apart(points, points[far : far + 1])[:, 0])
        self.centers = points[order]
        self.levels, width = [1], 1.0
        while self.levels[-1] < len(order):
            n = sum(w > width for w in widths)
            if n > self.levels[-1]:
                self.levels.append(n)
            width /= 2
            if width < 1e-9:
                self.levels.append(len(order))
        self.parents = [np.argmax(self.centers[:n] @ self.centers[: self.levels[k]].T, axis=1) for k, n in enumerate(self.levels[1:])]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and the distance to it."""
        cosine = rows @ self.centers.T
        leaf = np.argmax(cosine, axis=1)
        return leaf, np.sqrt(np.maximum(2 - 2 * cosine[np.arange(len(rows)), leaf], 0))

    def radii(self, leaves: np.ndarray) -> list[np.ndarray]:
        """Covering radii of the nodes of each level from those of the leaves (negative: empty)."""
        out = [leaves]
        for k in range(len(self.levels) - 2, -1, -1):
            n, below, parent = self.levels[k], out[0], self.parents[k]
            own = np.sqrt(np.maximum(2 - 2 * (self.centers[: self.levels[k + 1]] * self.centers[parent]).sum(1), 0)) + below
            up = np.full(n, -1.0)
            np.maximum.at(up, parent[below >= 0], own[below >= 0])
            out.insert(0, up)
        return out


def dual(a: CoverTree, ra: np.ndarray, b: CoverTree, rb: np.ndarray, reach: float) -> np.ndarray:
    """Which leaf of a may hold a row within `reach` of a row in which leaf of b; ra, rb: radii of the leaves."""
    la, lb = a.radii(ra), b.radii(rb)
    pairs = np.ones((1, 1), bool)
    for k in range(max(len(la), len(lb))):
        ka, kb = min(k, len(la) - 1), min(k, len(lb) - 1)
        if k:
            rows = a.parents[ka - 1] if k < len(la) else np.arange(len(la[-1]))
            cols = b.parents[kb - 1] if k < len(lb) else np.arange(len(lb[-1]))
            pairs = pairs[np.ix_(rows, cols)]
        pairs &= (la[ka] >= 0)[:, None] & (lb[kb] >= 0)[None, :]
        i, j = np.nonzero(pairs)
        far = np.sqrt(np.maximum(2 - 2 * (a.centers[i] * b.centers[j]).sum(1), 0)) if len(i) < 1 << 14 else _apart(a.centers[: len(la[ka])], b.centers[: len(lb[kb])])[i, j]
        pairs[i, j] = far <= la[ka][i] + lb[kb][j] + reach + _SLACK
    return pairs


class _Side:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, rows: np.ndarray):
        self.tree = CoverTree(rows[:: max(1, len(rows) // 512)], LOCAL)
        leaf, far = self.tree.assign(rows)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.weights, self.rows, leaf = ids[order], weights[order], rows[order], leaf[order]
        self.single = self.rows.astype(np.float32)
        n = len(self.tree.centers)
        self.radius = np.full(n, -1.0)
        np.maximum.at(self.radius, leaf, far[order])
        self.cuts = np.searchsorted(leaf, np.arange(n + 1))


def compare(x: _Side, y: _Side, cosine: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs over the threshold, in pieces; same: x is y, each pair once."""
    may = dual(x.tree, x.radius, y.tree, y.radius, float(np.sqrt(2 - 2 * cosine)))
    full = np.flatnonzero(may.all(1) | (may.sum(1) * 2 > may.shape[1]))
    spans = []  # runs of leaves of x that meet (nearly) all of y go into one product
    for i in range(len(may)):
        if x.cuts[i] == x.cuts[i + 1] or not may[i].any():
            continue
        if i in full and spans and spans[-1][2] is None and spans[-1][1] == x.cuts[i]:
            spans[-1][1] = x.cuts[i + 1]
        else:
            spans.append([x.cuts[i], x.cuts[i + 1], None if i in full else np.concatenate([np.arange(y.cuts[j], y.cuts[j + 1]) for j in np.flatnonzero(may[i])])])
    for s, e, cols in spans:
        right, right1 = (y.rows, y.single) if cols is None else (y.rows[cols], y.single[cols])
        step = max(1, PRODUCT // max(1, len(right)))
        for lo in range(s, e, step):
            hi = min(e, lo + step)
            i, j = np.nonzero(x.single[lo:hi] @ right1.T >= cosine - 1e-4)
            ok = (x.rows[lo:hi][i] * right[j]).sum(1) >= cosine if len(i) else np.empty(0, bool)
            i, j = i[ok] + lo, j[ok]
            if cols is not None:
                j = cols[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _found(x: _Side, y: _Side, cosine: float, same: bool = False) -> Iterator[pa.RecordBatch]:
    """kind 0: a and b are linked; kind 1: a has b more links (copies counted)."""
    for i, j in compare(x, y, cosine, same):
        nodes, at = np.unique(np.concatenate([x.ids[i], y.ids[j]]), return_inverse=True)
        low = nodes[numpy_components(len(nodes), at[: len(i)], at[len(i) :])]
        n = np.bincount(at, np.concatenate([y.weights[j], x.weights[i]]), len(nodes)).astype(np.int64)
        star = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.int8([0, 1]), [star.sum(), len(nodes)])), pa.array(np.concatenate([nodes[star], nodes])), pa.array(np.concatenate([low[star], n]))], ["kind", "a", "b"])


def _vectors(column: pa.Array, kind: type) -> np.ndarray:
    data = column.to_pylist()
    return unit(np.frombuffer(b"".join(data), kind).reshape(len(data), -1))


def search(classes: DataFrame, kind: type, cosine: float) -> DataFrame:
    """classes: cls long, n long, vec binary (all of one length). kind, a, b as of _found()."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("vec"), "cls").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    tree = spark.sparkContext.broadcast(CoverTree(_vectors(sample, kind), min(CELLS, max(1, -(-total // BLOCK)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf, far = tree.value.assign(_vectors(b.column(0), kind))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(far)], ["leaf", "far"])

    # one row per cell comes to the driver: CELLS at most
    radius, count = np.full(len(tree.value.centers), -1.0), np.zeros(len(tree.value.centers), np.int64)
    for r in classes.select("vec").mapInArrow(place, "leaf int, far double").groupBy("leaf").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r["leaf"]], count[r["leaf"]] = r["far"], r["n"]
    reach = float(np.sqrt(2 - 2 * cosine))
    may = dual(tree.value, radius, tree.value, radius, reach)
    blocks = np.maximum(1, -(-count // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = _vectors(b.column(2), kind)
            far = _apart(rows, tree.value.centers)
            own = tree.value.assign(rows)[0]
            mix = ((b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks[own]
            for cell in range(len(blocks)):
                # a vector visits the cells before its own whose ball it may reach, and the blocks before its own
                at = np.flatnonzero((own == cell) | (own > cell) & may[cell][own] & (far[:, cell] <= radius[cell] + reach + _SLACK))
                for block in range(blocks[cell] if len(at) else 0):
                    go = at[(own[at] > cell) | (mix[at] >= block)]
                    if len(go):
                        visits = ((own[go] > cell) | (mix[go] > block)).astype(np.int8)
                        moved = b.take(pa.array(go))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), cell, np.int32)), pa.array(np.full(len(go), block, np.int32)), pa.array(visits), *moved.columns], ["cell", "block", "visits", "cls", "n", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, home = None, [], None

        def side(parts: list[pa.RecordBatch]) -> _Side:
            whole = pa.Table.from_batches(parts)
            return _Side(whole["cls"].to_numpy(), whole["n"].to_numpy(), _vectors(whole["vec"], kind))

        for b in batches:
            if not b.num_rows:
                continue
            cell, block, visits = (b.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (visits[1:] != visits[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
                if (now := (cell[s], block[s])) != key:
                    if own and home is None:
                        home = side(own)
                        yield from _found(home, home, cosine, True)
                    key, own, home = now, [], None
                part = b.slice(s, e - s)
                if not visits[s]:
                    own.append(part)
                elif own:
                    if home is None:
                        home = side(own)
                        yield from _found(home, home, cosine, True)
                    yield from _found(home, side([part]), cosine)
        if own and home is None:
            home = side(own)
            yield from _found(home, home, cosine, True)

    dealt = classes.select("cls", "n", "vec").mapInArrow(deal, "cell int, block int, visits byte, cls long, n long, vec binary")
    return dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "visits").mapInArrow(run, "kind byte, a long, b long")


def near_vectors(embeddings: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of
    different lengths. Each row is a vector of its own, so repeated rows link with each other; a null vec_id takes part
    and never names a component, unless all of it are null (then component_id is null and kept is true)."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    dtype = np.float32 if kind == "array<float>" else np.float64
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(dtype)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            data = [None if x else (flat[s:e] + dtype(0)).tobytes() for x, s, e in zip(null, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["vec_id", "vec"])

    id_kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = embeddings.select("vec_id", F.when(good, F.col("embedding").cast("array<float>" if dtype is np.float32 else "array<double>")).alias("e")).mapInArrow(pack, f"vec_id {id_kind}, vec binary")
    rows, _ = materialize(rows.withColumn("_uid", F.monotonically_increasing_id()), "vectors")
    classes, _ = materialize(rows.where("vec is not null").groupBy("vec").agg(F.min("_uid").alias("cls"), F.count("*").alias("n"), F.min("vec_id").alias("low")), "vector-classes")
    lengths = [r[0] for r in classes.select(F.length("vec").alias("l")).distinct().orderBy("l").collect()]
    found = [search(classes.where(F.length("vec") == n), dtype, cosine) for n in lengths]
    if found:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        every, _ = materialize(every, "vector-links")
    else:
        every = embeddings.sparkSession.createDataFrame([], "kind byte, a long, b long")
    counts = every.where("kind = 1").groupBy(F.col("a").alias("c")).agg(F.sum("b").alias("more"))
    parts = connected(every.where("kind = 0").select("a", "b"))
    placed = classes.join(counts, F.col("cls") == F.col("c"), "left").join(parts, F.col("cls") == F.col("node"), "left")
    placed = placed.select("vec", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("_links"), F.coalesce("component", "cls").alias("_root"), "low")
    roots = placed.groupBy(F.col("_root").alias("_r")).agg(F.min("low").alias("component_id"))
    of = placed.join(roots, F.col("_root") == F.col("_r")).select(F.col("vec").alias("_v"), "_links", "component_id")
    out = rows.join(of, F.col("vec") == F.col("_v"), "left")
    alone = F.col("_v").isNull()
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
