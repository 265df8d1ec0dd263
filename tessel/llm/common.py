"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import shared_folder

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, for Java regular expressions and translate().
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased. bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return raw.lower().split()


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Rows that a task turns into Python objects at once.
SLICE_ROWS = 1_000


def slices(batches, rows: int = SLICE_ROWS):
    """Record batches in slices of bounded length, so that the objects made of them stay few. What Arrow and the C library hold unused goes back at
    the end of the task: a worker process serves tasks of many stages, and would keep the most that any of them took."""
    try:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
            trim(0)


def word_count(text):
    """Column: number of words, 0 for null. Each word becomes one letter, so memory stays linear in the text."""
    marks = F.regexp_replace(text, f"[^{SPACE_CLASS}]++", "x")
    return F.coalesce(F.length(F.translate(marks, SPACE_CHARS, "")), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the context's checkpoint folder. Set here only where it is unset
    and all run on one machine (tests); a cluster without one is refused."""
    return shared_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Store a frame in the shared folder: later reads neither recompute it nor depend on an executor."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def store(frame: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """A frame written as a table in the shared folder and read again, and its path. For loops: unlike a checkpoint, the table does not
    carry over the constraints of the plan before it, which would pile up on the driver from round to round, and it can be dropped."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", compression).parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
