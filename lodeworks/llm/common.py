"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

#: Rows of a few numbers each that are small enough to be broadcast: some 20 MB.
SMALL_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Bound the memory of a Python worker and the disk: an Arrow batch holds BATCH_ROWS texts and BATCH_BYTES at most, and
    an action's shuffle files go when it ends. What is needed later is in the shared folder by then; else Spark makes it again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodeworks-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut the lineage there; Spark removes the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, which is counted on the way; a task that runs again may count twice, so it is at least that."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n"))), int(seen.get["n"])


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aid(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: broadcast while it has at most SMALL_ROWS rows."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; when a partition ends, the worker gives free memory back, as it lives on and others start beside it."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return own


class Scratch:
    """Tables in the shared folder that a loop writes, and drops when done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/lodeworks-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.top}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{self.n}")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id) -> "F.Column":
    """The fold that labels are never learned from: crc32(doc_id as text) mod 3 is 1. A null doc_id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ascii_lower(text):
    """Lower-cases A-Z alone. A text of ASCII characters only can take the faster lower()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
