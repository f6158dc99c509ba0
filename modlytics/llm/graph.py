"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlytics.llm import common


def stored(df: DataFrame) -> DataFrame:
    return common.stored(df, "none")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node that links reach) for every end of ``links`` (a, b).

    Each round hangs every node under its least neighbour, follows those parents twice, and replaces
    the ends of the links by what they hang under; links inside a tree vanish, so the link table
    shrinks fast.  Links and roots stay in tables; the driver sees one count per round.
    Loops and repeated links do no harm, nulls are left out, no links give no rows.
    """
    live = stored(links.select("a", "b").filter("a is not null and b is not null").distinct())
    roots = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node"))
    live = live.filter("a <> b")
    while live.limit(1).count():
        ends = live.unionAll(live.select("b", "a"))
        least = ends.groupBy("a").agg(F.min("b").alias("b"))
        parents = stored(least.select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        over = parents.select(F.col("node").alias("up"), F.col("up").alias("next"))
        for _ in range(2):
            parents = parents.join(over, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        parents = stored(parents)
        roots = stored(
            roots.join(parents.select(F.col("node").alias("root"), "up"), "root", "left")
            .select("node", F.coalesce("up", "root").alias("root"))
        )
        for end in ("a", "b"):
            live = live.join(parents.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end)
        live = stored(
            live.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).filter("a <> b").distinct()
        )
    return roots
