"""A folder of images as a stream: files that arrive are decoded to tiles and written once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import formats


def tiles(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A streaming DataFrame of CHUNK rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from formats.batched(formats.decode(name, data))

    return files.mapInArrow(run, formats.CHUNK)


def convert(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Everything that is there now, then it stops; called again it goes on with what came since."""
    return tiles(spark, path, pattern).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("level").trigger(availableNow=True).start()
