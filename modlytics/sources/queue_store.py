"""The review queue as a stored table: a snapshot, the parts that came after it, and versions that name both.

``<path>/entries/query=<writer>/batch=<n>``   what one batch of a writer brought, there once it holds ``_SUCCESS``
``<path>/snapshots/<version>-<random>``       everything up to a version, one row per queue_id
``<path>/versions/<version>.json``            a version: its snapshot and the last batch of every writer in it

An entry is (queue_id, item, review); one of the two is null when it arrives.  Folding entries is
associative, so a snapshot is folded with later parts by the same aggregate that made it.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlytics.operators.queue import is_expired
from modlytics.schema import QUEUE_SCHEMA, REVIEW_SCHEMA
from modlytics.sources.files import exists, matching, put_once, read_small, remove

ITEM_TYPE = QUEUE_SCHEMA
# In this order the greatest review is the last one.
REVIEW_TYPE = T.StructType([REVIEW_SCHEMA[name] for name in ("reviewed_at", "action", "moderator_notes")])
ENTRY_SCHEMA = T.StructType(
    [T.StructField("queue_id", T.StringType()), T.StructField("item", ITEM_TYPE), T.StructField("review", REVIEW_TYPE)]
)


class Version(NamedTuple):
    number: int
    snapshot: str | None
    batches: dict[str, int]


def queue_entries(items: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Items and reviews as entries; batch or streaming frames."""
    parts = []
    if items is not None:
        item = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ITEM_TYPE))
        parts.append(items.select("queue_id", item.alias("item"), F.lit(None).cast(REVIEW_TYPE).alias("review")))
    if reviews is not None:
        review = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEW_TYPE))
        parts.append(reviews.select("queue_id", F.lit(None).cast(ITEM_TYPE).alias("item"), review.alias("review")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fold_entries(entries: DataFrame) -> DataFrame:
    """One entry per queue_id: the item as it came first, and its last review.

    Entries of one id are folded before the shuffle.  Items of one time are ordered by content, so every reading
    agrees.
    """
    created = F.coalesce(F.col("item.created_at"), F.lit(0).cast("timestamp"))
    order = F.when(F.col("item").isNotNull(), F.struct(created, F.xxhash64(F.to_json("item"))))
    return entries.groupBy("queue_id").agg(F.min_by("item", order).alias("item"), F.max("review").alias("review"))


def newest_version(spark: SparkSession, path: str) -> Version:
    """The version that readers see; number 0 before the first."""
    numbers = [int(name.rsplit("/", 1)[1][:-5]) for name in matching(spark, f"{path}/versions/*.json")]
    if not numbers:
        return Version(0, None, {})
    return Version(max(numbers), **json.loads(read_small(spark, f"{path}/versions/{max(numbers)}.json")))


def finished_parts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(writer, batch) of all parts that were written to their end."""
    found = matching(spark, f"{path}/entries/query=*/batch=*/_SUCCESS")
    named = [re.search(r"/query=([^/]+)/batch=(\d+)/_SUCCESS$", name) for name in found]
    return sorted((match[1], int(match[2])) for match in named)


def later_parts(spark: SparkSession, path: str, version: Version) -> list[tuple[str, int]]:
    return [(w, n) for w, n in finished_parts(spark, path) if n > version.batches.get(w, -1)]


def _part(path: str, writer: str, batch: int) -> str:
    return f"{path}/entries/query={writer}/batch={batch}"


def append_entries(entries: DataFrame, path: str, writer: str, batch: int) -> bool:
    """Write what one batch of a writer brought; False, and nothing written, if it is there already.

    The batches of a writer come in order, as those of a streaming query do.
    """
    spark = entries.sparkSession
    known = newest_version(spark, path).batches.get(writer, -1)
    if batch <= known or exists(spark, f"{_part(path, writer, batch)}/_SUCCESS"):
        return False
    entries.write.mode("overwrite").parquet(_part(path, writer, batch))
    return True


def _entries(spark: SparkSession, path: str, version: Version, later: list[tuple[str, int]]) -> DataFrame:
    folders = [f"{path}/snapshots/{version.snapshot}"] if version.snapshot else []
    folders += [_part(path, *part) for part in later]
    return spark.read.schema(ENTRY_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], ENTRY_SCHEMA)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The folded entries, from the newest snapshot and the parts after it; nothing else is opened."""
    version = newest_version(spark, path)
    later = later_parts(spark, path, version)
    stored = _entries(spark, path, version, later)
    return fold_entries(stored) if later else stored


def queue_of(entries: DataFrame) -> DataFrame:
    """The queue's rows, each item's last review written in."""
    hit = F.col("review").isNotNull()
    changed = {
        "status": F.lit("reviewed"),
        "final_action": F.col("review.action"),
        "moderator_notes": F.col("review.moderator_notes"),
        "reviewed_at": F.col("review.reviewed_at"),
    }
    columns = [
        F.when(hit, changed[name]).otherwise(F.col(f"item.{name}")).alias(name) if name in changed else F.col(f"item.{name}")
        for name in ITEM_TYPE.fieldNames()
    ]
    return entries.filter(F.col("item").isNotNull()).select(*columns)


def unknown_of(entries: DataFrame) -> DataFrame:
    """The last review of every id that the queue does not hold."""
    return entries.filter(F.col("item").isNull()).select("queue_id", "review.*").select(*REVIEW_SCHEMA.fieldNames())


def compact_queue(spark: SparkSession, path: str, as_of: Column | None = None, days: int = 30) -> int:
    """Fold the snapshot and later parts into a new version; the number of items left out as too old.

    With ``as_of``, items created more than ``days`` before it (or without a time) are left out, and so are
    reviews of unknown ids given before then.  Of two compactions at a time one fails and changes nothing.  Readers
    that have begun keep their files until ``vacuum_queue``.
    """
    before = newest_version(spark, path)
    later = later_parts(spark, path, before)
    entries = fold_entries(_entries(spark, path, before, later))
    age = F.when(F.col("item").isNotNull(), F.col("item.created_at")).otherwise(F.col("review.reviewed_at"))
    old = F.lit(False) if as_of is None else is_expired(as_of, days, age)
    seen = Observation()
    counted = entries.observe(seen, F.count_if(old & F.col("item").isNotNull()).alias("removed"))
    number = before.number + 1
    snapshot = f"{number}-{uuid.uuid4().hex}"
    counted.filter(~old).write.parquet(f"{path}/snapshots/{snapshot}")
    batches = dict(before.batches)
    for writer, batch in later:
        batches[writer] = max(batch, batches.get(writer, -1))
    if not put_once(spark, f"{path}/versions/{number}.json", json.dumps({"snapshot": snapshot, "batches": batches})):
        remove(spark, f"{path}/snapshots/{snapshot}")
        raise RuntimeError(f"{path}: another compaction made version {number}")
    return seen.get["removed"]


def vacuum_queue(spark: SparkSession, path: str) -> None:
    """Delete what readers of the newest version do not open: folded parts and the snapshots before it."""
    newest = newest_version(spark, path)
    for writer, batch in finished_parts(spark, path):
        if batch <= newest.batches.get(writer, -1):
            remove(spark, _part(path, writer, batch))
    for folder in matching(spark, f"{path}/snapshots/*"):
        name = folder.rsplit("/", 1)[1]
        if name != newest.snapshot and int(name.split("-")[0]) <= newest.number:
            remove(spark, folder)


def purge_stored_queue(spark: SparkSession, path: str, as_of: Column, days: int = 30) -> int:
    """Remove old items from the stored queue, files and all; how many there were."""
    removed = compact_queue(spark, path, as_of, days)
    vacuum_queue(spark, path)
    return removed
