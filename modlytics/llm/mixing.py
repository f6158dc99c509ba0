"""Mix sources to target weights: exact quotas, split among output shards by a hypergeometric tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlytics.llm.common import WORD, stored


@dataclass(frozen=True)
class Settings:
    """``weights`` go round the sources in the order of their names; ``most``: how often a text is taken at most.

    A block is ``block`` texts that follow each other in their source's random order; a shard holds
    ``shard`` blocks; a bucket of about ``bucket`` texts is ordered at a time.  Where a source's last
    pass ends, up to ``near`` texts on either side are looked at to come nearer to the target.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block: int = 64
    shard: int = 64
    bucket: int = 512
    near: int = 64
    seed: int = 17


def sized(docs: DataFrame, key: str, text: str, source: str, settings: Settings, carry: bool = False) -> DataFrame:
    """The rows with a number, their words and their place in the random order, in a table.

    The order depends on key, text and seed only; equal rows are told apart by their number.
    """
    inner = [F.col(name).alias(f"c{place}") for place, name in enumerate(docs.columns)] if carry else []
    return stored(
        docs.select(
            *inner,
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.col(key), F.col(text), F.lit(settings.seed)).alias("draw"),
        )
    )


def targets(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row per source: place, texts, source_size, target and what to take of it.

    A source's target is its weight times a common level, or ``most`` times its size if that is less.
    In the order of size over weight, the level at each source is what is left of all words when the
    sources before it are full, over the weights from it on.  It rises as long as sources are full
    and falls after, so the common level is its maximum.
    """
    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("texts")
    )
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(weight) for weight in settings.weights))
    listed = sums.withColumn("place", F.row_number().over(named) - 1).withColumn(
        "weight", F.element_at(weights, F.col("place") % len(settings.weights) + 1)
    )
    full = F.col("source_size").cast("double") * settings.most
    order = Window.orderBy("fullness", "place")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        listed.withColumn("full", full)
        .withColumn("fullness", F.col("full") / F.col("weight"))
        .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - before) / from_here)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least("full", F.col("level") * F.col("weight")))
    )
    words = F.least(F.round("target"), F.col("full")).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("int")
    return leveled.select("source", "place", "texts", "source_size", "target", passes.alias("passes"), (words - passes * F.col("source_size")).alias("rest"))


def ranked(rows: DataFrame, goals: DataFrame, settings: Settings) -> DataFrame:
    """Every text with its rank in its source's random order and ``turn``, its rank in the last pass, or null.

    The last pass takes the texts that fit whole, in random order.  If words are then missing, one
    more text near the end is added, or put in the place of a taken one, where the sum comes nearer to
    the target by that; no text is cut.  Texts fall into buckets by the leading bits of their draw, so a source of any size is ordered
    bucket by bucket; only the buckets' sums are added up along a source.
    """
    unit = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    buckets = F.ceil(F.col("texts") / settings.bucket)
    placed = (
        rows.filter("size > 0")
        .join(goals, rows["source"].eqNullSafe(goals["source"]))
        .select("row", "key", "size", "draw", "place", "texts", "passes", "rest", F.floor(unit * buckets).alias("bucket"))
    )
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "place", "bucket",
        F.coalesce(F.sum("words").over(along), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("n").over(along), F.lit(0)).alias("n_before"),
    )
    within = Window.partitionBy("place", "bucket").orderBy("draw", "key", "row")
    before = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = stored(
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .withColumn("before", before)
        .join(starts, ["place", "bucket"])
        .select(
            "row", "key", "size", "place", "texts", "passes", "draw",
            (F.col("rank") + F.col("n_before")).alias("rank"),
            (F.col("before") + F.col("words_before") + F.col("size") <= F.col("rest")).alias("fits"), "rest",
        )
    )
    change = stored(last_changes(ordered, settings))
    moved = F.when(F.col("rank") == F.col("enters"), F.col("leaves")).when(F.col("fits") & ~F.col("rank").eqNullSafe(F.col("leaves")), F.col("rank"))
    return ordered.join(change, "place", "left").select("row", "key", "size", "place", "texts", "passes", "draw", "rank", moved.alias("turn"))


def last_changes(ordered: DataFrame, settings: Settings) -> DataFrame:
    """(place, enters, leaves): the ranks of the text that joins a source's last pass, and of the one it replaces.

    Only sources that come nearer to their target by it have a row; where nothing is replaced,
    ``leaves`` is the rank behind the last one.
    """
    taken = F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))
    edges = stored(
        ordered.groupBy("place").agg((F.first("rest") - taken).alias("gap"), F.count_if("fits").alias("end")).filter("gap > 0")
    )
    around = stored(
        ordered.join(edges, "place").filter((F.col("rank") >= F.col("end") - settings.near) & (F.col("rank") < F.col("end") + settings.near))
        .select("place", "rank", "size", "fits", "gap", "end")
    )
    none = edges.select("place", F.col("end").alias("leaves"), F.lit(0).cast("bigint").alias("less"))
    out = around.filter("fits").select("place", F.col("rank").alias("leaves"), F.col("size").alias("less")).unionByName(none)
    missing = F.abs(F.col("gap") - F.col("size") + F.col("less"))
    return (
        around.filter("not fits").join(out, "place").filter(missing < F.col("gap"))
        .groupBy("place").agg(F.min(F.struct(missing.alias("missing"), F.col("rank").alias("enters"), (-F.col("leaves")).alias("leaves"))).alias("best"))
        .select("place", "best.enters", (-F.col("best.leaves")).alias("leaves"))
    )


#: ln(n!) as SQL: fixed values up to 9, Stirling's series above.
LOG_FACTORIAL = (
    "CASE WHEN {n} < 10 THEN element_at(array("
    + ", ".join(f"{math.lgamma(n + 1)!r}D" for n in range(10))
    + "), CAST({n} AS INT) + 1) ELSE {n} * ln({n}) - {n} + 0.5D * ln(6.283185307179586D * {n})"
    " + 1D / (12D * {n}) - 1D / (360D * {n} * {n} * {n}) + 1D / (1260D * {n} * {n} * {n} * {n} * {n}) END"
)


def log_factorial(value: str) -> str:
    return LOG_FACTORIAL.format(n=f"CAST({value} AS DOUBLE)")


def hypergeometric(good: str, total: str, drawn: str, uniform: str) -> str:
    """SQL for one hypergeometric draw: how many of ``good`` among ``total`` are in a sample of ``drawn``.

    The distribution is inverted over all outcomes within twelve standard deviations of the mode;
    what lies beyond has less weight than a double can add to one.
    """
    low, high = f"greatest(0L, {drawn} - {total} + {good})", f"least({good}, {drawn})"
    mode = f"least({high}, greatest({low}, CAST(floor(({drawn} + 1D) * ({good} + 1D) / ({total} + 2D)) AS BIGINT)))"
    spread = f"CAST(ceil(12D * sqrt(CAST({drawn} AS DOUBLE) * {good} / {total} * ({total} - {good}) / {total} + 1D)) AS BIGINT) + 12L"

    def logp(x: str) -> str:
        parts = (x, f"({good} - {x})", f"({drawn} - {x})", f"({total} - {good} - {drawn} + {x})")
        return "-(" + " + ".join(log_factorial(part) for part in parts) + ")"

    outcomes = f"sequence(greatest({low}, {mode} - {spread}), least({high}, {mode} + {spread}))"
    weights = f"transform({outcomes}, x -> named_struct('x', x, 'p', exp({logp('x')} - {logp(mode)})))"
    sums = f"aggregate(w, 0D, (s, e) -> s + e.p)"
    pick = (
        f"aggregate(w, named_struct('left', {uniform} * {sums}, 'x', w[0].x, 'done', false), (s, e) -> "
        "CASE WHEN s.done THEN s ELSE named_struct('left', s.left - e.p, 'x', e.x, 'done', s.left <= e.p) END, s -> s.x)"
    )
    # A one-element array binds the weights to a name.
    drawn_value = f"transform(array({weights}), w -> {pick})[0]"
    return f"CASE WHEN {total} = 0L OR {drawn} = 0L OR {good} = 0L THEN 0L WHEN {drawn} = {total} THEN {good} ELSE {drawn_value} END"


def shard_quotas(goals: DataFrame, units: DataFrame, settings: Settings) -> DataFrame:
    """(shard, place, from, to): which blocks of each source's random order go to which shard.

    All blocks of all sources are dealt to shards of equal size, as a shuffle of all of them would.
    A node of the tree holds a range of shards and the blocks of each source that they share.  It is
    halved: the left half's blocks are a multivariate hypergeometric draw, source after source, so
    at every node the quotas add up exactly.
    """
    blocks = units.groupBy("place").agg(F.count(F.lit(1)).alias("units")).select(
        "place", F.ceil(F.col("units") / settings.block).alias("blocks")
    )
    all_blocks = F.array_sort(F.collect_list(F.struct("place", F.coalesce("blocks", F.lit(0).cast("bigint")).alias("blocks"))))
    root = (
        goals.select("place").join(blocks, "place", "left").agg(all_blocks.alias("q"))
        .select(F.col("q.blocks").alias("q"), F.expr("aggregate(q.blocks, 0L, (s, e) -> s + e)").alias("total"))
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("total") / settings.shard)).cast("bigint"))
        .select("q", "total", "shards", F.lit(0).cast("bigint").alias("lo"), F.col("shards").alias("hi"))
    )
    nodes = stored(root)
    head = nodes.select("shards").first()
    levels = max(0, math.ceil(math.log2(head["shards"]))) if head else 0
    uniform = f"((shiftrightunsigned(xxhash64(lo, hi, i, {settings.seed}), 11) + 0.5D) / 9007199254740992D)"
    draw = hypergeometric("e.q", "s.n", "s.k", uniform.replace(", i,", ", e.i,"))
    split = (
        "aggregate(transform(q, (v, i) -> named_struct('q', v, 'i', i)), "
        "named_struct('n', aggregate(q, 0L, (s, e) -> s + e), 'k', k, 'out', CAST(array() AS ARRAY<BIGINT>)), "
        f"(s, e) -> transform(array({draw}), d -> named_struct('n', s.n - e.q, 'k', s.k - d, 'out', array_append(s.out, d)))[0], "
        "s -> s.out)"
    )
    share = "CAST(floor(CAST(total AS DECIMAL(38, 0)) * {end} / shards) AS BIGINT)"
    for _ in range(levels):
        halved = (
            nodes.filter("hi - lo > 1")
            .withColumn("mid", F.expr("(lo + hi) div 2"))
            .withColumn("k", F.expr(f"{share.format(end='mid')} - {share.format(end='lo')}"))
            .withColumn("left", F.expr(split))
            .withColumn("right", F.expr("zip_with(q, left, (a, b) -> a - b)"))
        )
        children = halved.select(
            F.explode(
                F.array(
                    F.struct(F.col("left").alias("q"), "total", "shards", "lo", F.col("mid").alias("hi")),
                    F.struct(F.col("right").alias("q"), "total", "shards", F.col("mid").alias("lo"), "hi"),
                )
            ).alias("child")
        ).select("child.*")
        nodes = stored(nodes.filter("hi - lo <= 1").unionByName(children))
    along = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return (
        nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("place", "blocks"))
        .withColumn("to", F.sum("blocks").over(along))
        .select("shard", "place", (F.col("to") - F.col("blocks")).alias("from"), "to")
        .filter("to > from")
    )


def mixed(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The sources' goals, and the mix: (row, copy, words, shard, position), from rows of sized()."""
    goals = stored(targets(rows, settings))
    texts = ranked(rows, goals, settings)
    copies = F.explode(F.sequence(F.lit(0), F.col("passes") + F.col("turn").isNotNull().cast("int") - 1))
    units = stored(
        texts.filter("passes > 0 or turn is not null")
        .select("*", copies.alias("copy"))
        .select(
            "row", "place", "copy", "draw", F.col("size").alias("words"),
            F.floor((F.col("copy") * F.col("texts") + F.when(F.col("copy") < F.col("passes"), F.col("rank")).otherwise(F.col("turn"))) / settings.block).alias("block"),
        )
    )
    quotas = shard_quotas(goals, units, settings)
    dealt = quotas.select("place", "shard", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("block"))
    local = Window.partitionBy("shard").orderBy(F.xxhash64("draw", "copy", F.lit(settings.seed + 1)), "row", "copy")
    mix = units.join(dealt, ["place", "block"]).withColumn("position", F.row_number().over(local) - 1)
    return goals, mix.select("row", "copy", "words", "shard", "position")


def mix_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: Settings | None = None) -> DataFrame:
    """Per row of ``docs``: key, size, source_size, target, taken.

    Texts are taken whole.  Full passes over a source take each of its texts; the last pass takes texts in
    random order as long as they fit, and then one more, or one in exchange for another, where the words
    come nearer to the target by that.  Null texts and texts without words have the size 0 and are not taken; a null
    source is a source, the last one.  Repeated rows are taken row by row, null keys stay, other columns are left
    out, and an empty table gives no rows.  Reruns over the same rows agree.
    """
    settings = settings or Settings()
    rows = sized(docs, key, text, source, settings)
    goals, mix = mixed(rows, settings)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    per_source = goals.select(F.col("source").alias("name"), "source_size", "target")
    return (
        rows.join(per_source, F.col("source").eqNullSafe(F.col("name")))
        .join(taken, "row", "left")
        .select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))
    )


def mix_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", settings: Settings | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as they are taken, shard by shard in shuffled order.

    Texts are whole.  The columns are those of ``docs``.
    """
    settings = settings or Settings()
    rows = sized(docs, key, text, source, settings, carry=True)
    _, mix = mixed(rows, settings)
    inner = {name: f"c{place}" for place, name in enumerate(docs.columns)}
    return (
        rows.join(mix, "row")
        .repartition("shard")
        .sortWithinPartitions("shard", "position")
        .select(*(F.col(short).alias(name) for name, short in inner.items()))
    )
