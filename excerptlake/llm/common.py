"""Shared helpers of the training-data operators: table access, Arrow mapping, working folders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..session import ship

#: Rows and bytes of what an operator's batch function is given at once (a longer row comes alone).
#: Spark hands over batches of at most spark.sql.execution.arrow.maxBytesPerBatch and a row.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder; workers find the package from here on."""
    return session.work_folder(ship(spark))


#: Settings while an intermediate result is written: shuffle files of the execution are removed at
#: its end, and batches to Python hold few bytes.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(2 * ROWS_PER_BATCH),
}


def cut(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write df to path in the shared folder and read it back: lineage ends there.

    An operator that works in several such steps holds one step's shuffle on disk, not the sum of
    them. The session's own settings are as before afterwards.
    """
    spark = df.sparkSession
    before = {key: spark.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(batches: Iterable[pa.RecordBatch], rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The rows of batches, none empty, in batches of at most so many rows and bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.num_rows <= rows and batch.nbytes <= size:
            yield batch
            continue
        begin = 0
        while begin < batch.num_rows:
            n = min(rows, batch.num_rows - begin)
            while n > 1 and batch.slice(begin, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.take(pa.array(np.arange(begin, begin + n)))  # a copy: kernels read offsets of slices wrong
            begin += n


def map_arrow(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]]],
    schema: str | T.StructType,
) -> DataFrame:
    """mapInArrow with per-worker set-up: make() runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches_of(batches):
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        pa.default_memory_pool().release_unused()  # workers stay for other operators' tasks

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def extended(df: DataFrame, **types: str) -> T.StructType:
    """df's schema with further columns (name=type)."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in types.items()]
    return T.StructType([*df.schema.fields, *more])


def input_bytes(df: DataFrame) -> int:
    """Size of the scanned input as the optimizer estimates it (file sizes for a plain scan).

    Rows that come from no file have no known size; they count as 16 MB a shuffle partition.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 24
    return size


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
