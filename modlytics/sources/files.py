"""Small files beside tables, through the file system that Spark reads the tables with."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(location), files


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob names, in order."""
    location, files = _place(spark, pattern)
    return sorted(str(status.getPath()) for status in files.globStatus(location) or ())


def exists(spark: SparkSession, path: str) -> bool:
    location, files = _place(spark, path)
    return files.exists(location)


def read_small(spark: SparkSession, path: str) -> str:
    location, files = _place(spark, path)
    stream = files.open(location)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    location, files = _place(spark, path)
    files.delete(location, True)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file as a whole under a name nobody has taken; False if somebody has.

    The content is written under another name first; the rename is the one step that readers see.
    """
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    draft, files = _place(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _place(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(rename, 1)
    never_over[0] = rename.NONE
    try:
        context.rename(draft, target, never_over)
    except Exception:
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise
    return True
