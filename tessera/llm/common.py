"""What several operators need: words, shared tables, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_JAVA = r"[^\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Spark's own default for spark.checkpoint.dir; it counts as unset.
_UNSET = {"", "/tmp/checkpoints"}
_written: dict[str, SparkSession] = {}
#: Rows of an Arrow batch, and the setting that says so.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def words(text: bytes) -> list[bytes]:
    """UTF-8 words; bytes.split() splits at exactly the six ASCII white-space characters."""
    return text.split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset, which only
    a session in one process (tests) may use: on several machines each would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if at in _UNSET:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = spark.conf.get("spark.tessera.scratch.dir", "") or tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.scratch.dir", at)
    return at


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, for this session from now on: texts are long, and each batch is held by the
    executor and its Python worker, coming and going. A smaller setting of the session's own stays."""
    if not 0 < int(spark.conf.get(_ROWS_SETTING, "10000")) <= BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to `rows` rows and, by their average row, `size` bytes; an empty batch gives none."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df once to the shared folder and reads it back, which cuts its lineage: a lost executor loses none of it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"tessera-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def release(*paths: str) -> None:
    """Removes tables of materialize() that no plan needs any more."""
    for path in paths:
        spark = _written.pop(path, None)
        if spark is not None:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            release(path)
        except Exception:  # the session is gone: nothing can be removed through it
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def numpy_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node that each node reaches."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def null_key(*columns) -> object:
    """A text key of the columns in which null differs from every value."""
    return F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
