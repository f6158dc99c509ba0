"""Read and write prediction logs: JSON lines, wrapped items, dated tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlytics.functions.values import iso_utc, parse_ts
from modlytics.schema import LOG_SCHEMA

CORRUPT = "_corrupt_record"


def parse_log_lines(
    lines: DataFrame, line: str = "value", schema: T.StructType = LOG_SCHEMA, keep: tuple = ()
) -> DataFrame:
    """JSON text to log columns; ``_corrupt_record`` holds a line that is not a record."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select(*keep, F.from_json(F.col(line), wide, options).alias("r"), F.col(line).alias("_l"))
    # Text that is empty or holds no object gives no struct at all: corrupt as well.
    broken = F.when(F.col("r").isNull(), F.coalesce("_l", F.lit(""))).otherwise(F.col(f"r.{CORRUPT}"))
    return parsed.select(
        *keep, *(F.col(f"r.{name}").alias(name) for name in schema.fieldNames()),
        broken.alias(CORRUPT),
    )


def split_log_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines)."""
    good = parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = parsed.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def read_log_lines(
    spark: SparkSession, path: str, mode: str = "tolerant"
) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines) of a JSON-lines log.

    ``strict`` fails the job on the first broken line, a blank one included, whatever columns the job
    needs; ``tolerant`` sets it aside.
    """
    if mode not in ("tolerant", "strict"):
        raise ValueError(f"Unknown mode: {mode}")
    parsed = parse_log_lines(spark.read.text(path))
    good, bad = split_log_lines(parsed)
    if mode == "strict":
        # In a filter, so that a job which needs no column still looks at every line.
        broken = F.concat(F.lit("Broken log line: "), F.substring(CORRUPT, 1, 200))
        checked = F.when(F.col(CORRUPT).isNull(), True).otherwise(F.raise_error(broken).cast("boolean"))
        return parsed.filter(checked).drop(CORRUPT), bad
    return good, bad


def read_log_items(
    items: DataFrame,
    max_items: int | None = None,
    schema: T.StructType = LOG_SCHEMA,
    data: str = "data",
    keep: tuple = (),
) -> DataFrame:
    """Unwrap the JSON in ``data``; items without it or with broken JSON are skipped."""
    parsed = parse_log_lines(items.filter(F.col(data).isNotNull()), data, schema, keep)
    good = parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good.limit(max_items) if max_items else good


def record_json(columns: Iterable[Column | str]) -> Column:
    """A row of some columns as JSON; timestamps keep their microseconds."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return F.to_json(F.struct(*columns), options)


def content_hash(df: DataFrame) -> Column:
    """A hash of what a row says: neither the order of its columns, nor of its maps' keys, nor a null counts."""
    in_order = lambda field: (
        F.map_from_entries(F.array_sort(F.map_entries(field.name)))
        if isinstance(field.dataType, T.MapType)
        else F.col(field.name)
    )
    fields = sorted(df.schema.fields, key=lambda field: field.name)
    return F.md5(record_json(in_order(field).alias(field.name) for field in fields))


def united_part(store: DataFrame, united: DataFrame) -> DataFrame:
    """A store with all columns of the union, in its order and types."""
    own = set(store.columns)
    return store.select(
        *(
            (F.col(field.name) if field.name in own else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in united.schema.fields
        )
    )


def read_logs(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Both stores as one log, each record once, with the store it came from.

    A record in both counts as primary.  The stores may order their columns differently, and
    one may lack some.  Copies are folded before the shuffle, so a record repeated very often
    does not load one task.
    """
    united = primary.unionByName(fallback, allowMissingColumns=True)
    stores = []
    for rank, store in enumerate((primary, fallback)):
        whole = united_part(store, united)
        stores.append(
            whole.select(F.struct(*whole.columns).alias("r"), content_hash(whole).alias("hash"), F.lit(rank).alias("rank"))
        )
    both = stores[0].unionByName(stores[1])
    folded = both.groupBy(F.col("r.timestamp").alias("t"), F.col("r.endpoint").alias("e"), "hash").agg(
        F.min("rank").alias("rank"), F.first("r").alias("r")
    )
    source = F.when(F.col("rank") == 0, "primary").otherwise("fallback")
    return folded.select("r.*", source.alias("log_source"))


def log_items(df: DataFrame, as_of: Column, level: str = "INFO", pathname: str = "") -> DataFrame:
    """Wrapped items: keys, dates, level, and the whole record as JSON in ``data``.

    ``as_of`` is the time of writing and overrules the record's own timestamp.
    """
    stamp = iso_utc(as_of)
    day = F.date_format(as_of, "yyyy-MM-dd")
    record = df.withColumns(
        {
            "log_level": F.lit(level),
            "pathname": F.lit(pathname),
            "timestamp": stamp,
            "log_date": day,
        }
    )
    data = record_json(record.columns)
    spread = F.substring(F.md5(data), 1, 8)
    return record.select(
        F.concat(day, F.lit("#"), spread).alias("partition_key"),
        F.concat(stamp, F.lit("#"), spread).alias("sort_key"),
        stamp.alias("timestamp"),
        as_of.alias("ts"),
        day.alias("log_date"),
        F.lit(level).alias("log_level"),
        data.alias("data"),
    )


def write_log(items: DataFrame, path: str, mode: str = "append") -> None:
    """Append items to the dated log table.

    The rebalance hint gathers a day's rows into few files and splits a day that holds
    most of them over several tasks.  A file is in the order of time, so its row groups
    cover short spans and a range of times skips most of them.
    """
    placed = items.hint("rebalance", "log_date").sortWithinPartitions("log_date", "ts")
    placed.write.partitionBy("log_date").mode(mode).parquet(path)


def log_range(items: DataFrame, from_ts: Column, to_ts: Column) -> DataFrame:
    """Items with from <= ts < to; the dates prune partitions, the times row groups."""
    as_ts = lambda column: column.cast("timestamp")
    days = F.col("log_date").cast("date").between(
        as_ts(from_ts).cast("date"), as_ts(to_ts).cast("date")
    )
    return items.filter(days & (F.col("ts") >= as_ts(from_ts)) & (F.col("ts") < as_ts(to_ts)))


def read_log_range(spark: SparkSession, path: str, from_ts: str, to_ts: str) -> DataFrame:
    """``log_range`` on the table ``write_log`` wrote."""
    return log_range(spark.read.parquet(path), F.lit(from_ts), F.lit(to_ts))


def event_time(logs: DataFrame) -> DataFrame:
    """Adds ``ts``, the record's timestamp text as a timestamp."""
    return logs.withColumn("ts", parse_ts(F.col("timestamp")))
