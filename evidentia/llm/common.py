"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast; beyond this the same join is left to a shuffle.
BROADCAST_LIMIT = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "evidentia-shared")
    return folder.rstrip("/")


#: Where each stored table of this driver lies.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``stored`` returned, once all that was read from them is itself stored."""
    for df in tables:
        if path := _paths.pop(df, None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table that ``stored`` returned (Catalyst's own estimate, no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A stored table marked for broadcast if its files are within ``limit``, else as it is."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def fenced(df: DataFrame) -> DataFrame:
    """``df`` behind a node that no later filter passes. A filter pushed below puts the definition of each column it
    names into its condition, also into lambdas over arrays, where it would be worked out again for each element."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``text`` of each holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        yield from _cut(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)), limit)


def list_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the lists of a column hold about ``limit`` elements in all, one row at least."""
    for batch in batches:
        yield from _cut(batch, np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0)), limit)


def _cut(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def sha_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
