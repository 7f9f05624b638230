"""Connected components in Spark: alternating large-star and small-star rounds over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numpy_components, release


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars around the smallest node that they reach within it."""
    for b in batches:
        links = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) if b.num_rows else np.empty((2, 0), np.int64)
        nodes, at = np.unique(links, return_inverse=True)
        at = at.reshape(2, -1)
        low = nodes[numpy_components(len(nodes), at[0], at[1])]
        other = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(low[other])], ["u", "v"])


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every node links its larger neighbours to its smallest one, then its smaller neighbours too. Nodes
    with many neighbours have many rows only on the side of a join that Spark can split."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.join(_lowest(both), F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    joined = large.join(_lowest(large), F.col("u") == F.col("k"))
    pairs = F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return joined.select(F.explode(pairs).alias("e")).select("e.u", "e.v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Links up to which one task joins all of them (16 bytes each); beyond, rounds over the whole table do.
FEW = 1 << 16


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        yield from _contract(pa.Table.from_batches(parts).combine_chunks().to_batches())


def connected(links: DataFrame, few: int | None = None) -> DataFrame:
    """links: two long columns (any names, either order, repeats allowed). Returns node, component (the smallest node it
    reaches) for every node that stands in a link to another; written tables cut the lineage after each round."""
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(_contract, "u long, v long").distinct()
    edges, path = materialize(edges, "links")
    before = _state(edges)
    if 0 < before[0] <= (FEW if few is None else few):
        after, new = materialize(edges.coalesce(1).mapInArrow(_whole, "u long, v long"), "links")
        release(path)
        edges, before = after, (0,)
    while before[0]:
        after, new = materialize(_round(edges), "links")
        release(path)
        edges, path = after, new
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
