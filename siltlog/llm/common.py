"""What the corpus operators share: table access, stable intermediate tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.sources.tables import shared_dir

#: Spark's switch to remove the shuffle files of a query when it ends.
CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """Tables written to the shared folder to cut lineage; a lost executor costs a reread, not a recomputation. What a write has shuffled goes as it ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siltlog-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._siltlog_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables no later step reads."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._siltlog_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, at whose end the worker gives back what it has freed: it waits for its next task, and what it holds counts meanwhile."""

    def ran(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        freed()

    return ran


def freed() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system, where the library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rows_for(n: int, per_task: int, least: int) -> int:
    """Tasks for n rows."""
    return max(least, -(-n // per_task))
