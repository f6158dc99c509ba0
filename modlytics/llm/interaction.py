"""How filters interact: failures counted in 2x2x2x2x2 tables per part, contracted for every order of the filters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.llm.common import stored

#: The filters, in the order of the table's axes; E is the one that compares texts.
FILTERS = "ABCDE"
#: What an axis of the table contributes: documents that pass, that fail, or all.
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """The conditions under which a text fails the filters A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * F.size(words).cast("bigint"),
        100 * capitals.cast("bigint") > 2 * F.length(text).cast("bigint"),
        text.rlike("[#$%&*|]"),
    ]


def code_of(failed: list[Column]) -> Column:
    """The failures of a row as one number, the first filter in the highest place."""
    places = len(FILTERS) - 1
    return sum(failure.cast("int") * (1 << (places - at)) for at, failure in enumerate(failed))


def failure_codes(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """``part``, ``id``, ``side``, ``code`` and how many rows ``n`` share them.

    A text is compared by its SHA-256 and never shuffled.  The least id of each digest is counted inside
    the tasks first, and is joined back by digest and id together, so the rows of a text that a third of
    the table repeats spread over the tasks.  ``side`` spreads the rows without an id.
    """
    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    read = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("id"), whole)
    rows = stored(
        read.select("part", "id", F.unhex(F.sha2("text", 256)).alias("digest"), code_of(failures(F.col("text"))).alias("code"))
        .groupBy("digest", "id", "part", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    again = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id"], "left").select(
        "part", "id", "n",
        F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0).alias("side"),
        (F.col("code") + again.cast("int")).alias("code"),
    )


def contingency(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """Per part the cells of its table: ``cells`` holds code, documents, good and toxic documents, at most 32."""
    rows = failure_codes(docs, text, key, part)
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    labelled = rows.join(known.withColumn("side", F.lit(0).cast("bigint")), ["id", "side"], "left")
    marked = lambda name: F.sum(F.col("n") * F.coalesce(F.col(name), F.lit(0))).alias(name)
    cells = labelled.groupBy("part", "code").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))


class Tables:
    """The tables of some parts, with an axis for the parts, one for each filter, and one for what is counted."""

    def __init__(self, cells: list[list[dict]]) -> None:
        flat = np.zeros((len(cells), 1 << len(FILTERS), 3), np.int64)
        for place, own in enumerate(cells):
            for cell in own:
                flat[place, cell["code"]] = cell["n"], cell["good"], cell["toxic"]
        self.counts = flat.reshape(len(cells), *[2] * len(FILTERS), 3)

    def chosen(self, passed: str = "", failed: str = "") -> np.ndarray:
        """Per part the documents, good and toxic ones that pass some filters and fail some, whatever the others say."""
        axes = [PASS if name in passed else FAIL if name in failed else ALL for name in FILTERS]
        return np.einsum("pabcdem,a,b,c,d,e->pm", self.counts, *axes)

    def steps(self) -> Iterator[tuple[str, int, np.ndarray]]:
        """Every order of the filters and step (from 1), with the COUNTS of each part as columns."""
        orders = ["".join(order) for order in permutations(FILTERS)]
        lost = {(order, step): self.chosen(order[:step], order[step]) for order in orders for step in range(len(FILTERS))}
        share = {name: sum(removed[:, 0] for (order, step), removed in lost.items() if order[step] == name) for name in FILTERS}
        every = {name: self.chosen("", name)[:, 0] for name in FILTERS}
        alone = {name: self.chosen(FILTERS.replace(name, ""), name)[:, 0] for name in FILTERS}
        for (order, step), removed in lost.items():
            name = order[step]
            kept = self.chosen(order[: step + 1])[:, 0]
            gone = removed[:, 0]
            yield order, step + 1, np.stack([kept, gone, every[name] - gone, alone[name], removed[:, 1], removed[:, 2], share[name]], axis=1)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            some = batch.slice(start, 128)
            steps = list(Tables(some.column("cells").to_pylist()).steps())
            figures = np.stack([counts for *_, counts in steps], axis=1).reshape(-1, len(COUNTS))
            parts = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(steps))))
            orders = pa.array([order for order, *_ in steps] * some.num_rows, pa.string())
            places = pa.array([step for _, step, _ in steps] * some.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [parts, orders, places, *(pa.array(np.ascontiguousarray(figures[:, at])) for at in range(len(COUNTS)))],
                ["part", "filter_order", "step", *COUNTS],
            )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """What each of five filters removes at each place of each of their 120 orders, per ``part`` of ``docs``.

    A text fails A with under 200 words, B if fewer than half of its words differ, C if capitals A-Z
    are over 2 in 100 of its code points, D if it holds one of ``#$%&*|``, and E if a row with a smaller
    ``key`` holds the same text anywhere in the table.  Spark counts the rows of each part by the 32
    outcomes; a part's counts then form a tensor with one axis of pass and fail for each filter, and
    every figure is a contraction that takes pass, fail or both along each axis.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail it, but were removed before),
    ``unique_fails`` (fail no other), ``good_lost`` and ``toxic_lost`` (removed here, with a row of
    ``labels`` whose quality or toxic is 1) and ``shapley`` (removed by the filter, summed over all orders).

    A null text counts as empty, a null part as the empty string.  A row without a key passes E and has
    no labels; repeated rows count each, and a repeated row with the least key of its text passes E.
    A text of any length is one row of four flags after the scan.  Repeated rows of ``labels`` count once, with 1 if any says 1.
    An empty table gives no rows; other columns are left out.
    """
    tables = contingency(docs, labels, text, key, part)
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    return tables.mapInArrow(contract, f"part string, filter_order string, step int, {counts}")
