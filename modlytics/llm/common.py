"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.session import shared_folder

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


#: Lists that note the tables which stored() writes inside their block; every thread has its own.
COLLECTORS: ContextVar[tuple[list[str], ...]] = ContextVar("collectors", default=())


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that stored() writes inside, in this thread."""
    made: list[str] = []
    before = COLLECTORS.set((*COLLECTORS.get(), made))
    try:
        yield made
    finally:
        COLLECTORS.reset(before)


def release(docs: DataFrame, tables: list[str]) -> None:
    """Delete those tables that ``docs`` does not read, and take them off the list."""
    if not tables:
        return
    spark = docs.sparkSession
    read = docs.inputFiles()
    for path in list(tables):
        name = path.rpartition("/")[2]
        if not any(f"/{name}/" in file for file in read):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            tables.remove(path)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a frame into the shared folder and read it back, which cuts its lineage.

    The table lies where every executor reaches it, so a lost executor costs no recomputation.  Tables of
    numbers that many short jobs write are better left uncompressed: codecs hold buffers outside the heap.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    for made in COLLECTORS.get():
        made.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[dict[str, list]]:
    """A batch as short lists of Python values, so that few texts are held twice."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows).to_pydict()
