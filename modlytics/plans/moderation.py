"""Moderation of a whole comment table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlytics.operators.moderation import enqueue, moderate
from modlytics.operators.profile import validate_requests
from modlytics.operators.records import decision_log
from modlytics.sources.files import exists, matching, put_once

TABLES = ("decisions", "queue", "log", "rejected")


def moderate_requests(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    created_at: Column,
    text: str = "comment_text",
    content_key: str = "comment_id",
) -> tuple[DataFrame, DataFrame]:
    """(decisions of the valid requests, rejected requests with their reasons)."""
    checked = validate_requests(requests, text)
    valid = checked.filter("valid").drop("valid", "reasons")
    return moderate(score(valid), created_at, content_key), checked.filter(~F.col("valid"))


def written_part(spark: SparkSession, path: str, table: str, part: str) -> DataFrame | None:
    """A part of a table, or None where it was never finished."""
    folder = f"{path}/{table}/{part}"
    return spark.read.parquet(folder) if exists(spark, f"{folder}/_SUCCESS") else None


def commit_path(path: str, part: str) -> str:
    return f"{path}/commits/{part.replace('/', ',')}.json"


def committed_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts whose tables are all there."""
    names = [name.rsplit("/", 1)[1] for name in matching(spark, f"{path}/commits/*.json")]
    return sorted(name.removesuffix(".json").replace(",", "/") for name in names)


def read_committed(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """Decisions, queue, log or rejected rows of the parts that were committed; half-written parts do not show.

    All four tables read after each other may differ by parts committed meanwhile, never by half a part.
    ``schema`` is needed only while nothing is committed.  Folders inside a part, such as days, give no column.
    """
    folders = [f"{path}/{table}/{part}" for part in committed_parts(spark, path)]
    if folders:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*folders)
    if schema is None:
        raise FileNotFoundError(f"{path} holds no committed part")
    return spark.createDataFrame([], schema)


def moderate_table(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    created_at: Column,
    part: str,
    text: str = "comment_text",
    content_key: str = "comment_id",
) -> None:
    """Write decisions, queue rows, log rows and rejects to ``<path>/<table>/<part>``.

    A part names one set of requests for good, such as a day or a stream's batch.  If it was
    written before, its decisions stand: times and queue ids stay as reviewers know them, whatever
    ``created_at`` says now, and the other tables are written from them again.  A part
    that holds other requests is not touched; that is an error.  The part is committed when all four tables
    hold it, and a committed part is left as it is.
    Requests are scored once: the queue and the log are read off the written decisions.
    """
    spark = requests.sparkSession
    save = lambda df, table: df.write.mode("overwrite").parquet(f"{path}/{table}/{part}")
    decisions, rejected = moderate_requests(requests, score, created_at, text, content_key)
    before = written_part(spark, path, "decisions", part)
    if before is None:
        save(decisions, "decisions")
    else:
        keys = decisions.select(content_key)
        foreign = before.select(content_key).exceptAll(keys).union(keys.exceptAll(before.select(content_key)))
        if foreign.limit(1).count():
            raise ValueError(f"{path}/decisions/{part} holds the decisions of other requests")
        if exists(spark, commit_path(path, part)):
            return
    written = spark.read.schema(decisions.schema).parquet(f"{path}/decisions/{part}")
    save(enqueue(written, text), "queue")
    save(decision_log(written, text), "log")
    save(rejected, "rejected")
    put_once(spark, commit_path(path, part), json.dumps({"part": part, "tables": TABLES}))
