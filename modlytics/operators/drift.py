"""Confidence and text-length distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions.text import preview, text_length
from modlytics.functions.values import round_half_even
from modlytics.operators.sampling import sample_rows

TRAINING, INFERENCE = "Training Data", "Inference"


def confidence_histogram(predictions: DataFrame, bins: int = 20, places: int = 4) -> DataFrame:
    """Rows per equal bin of [0, 1]; the last bin is closed and empty bins are listed.

    Bins are found in whole steps of the rounded score, so an edge value never falls
    to the neighbour through a floating-point product.
    """
    scale = 10**places
    steps = F.round(F.col("max_probability") * scale).cast("bigint")
    index = F.least(F.floor(steps * bins / scale), F.lit(bins - 1))
    counted = (
        predictions.filter(F.col("max_probability").isNotNull())
        .groupBy(index.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    empty = predictions.sparkSession.range(bins).select(
        F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("rows")
    )
    lower = F.col("bin") / bins
    return (
        counted.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("rows").alias("rows"))
        .select(
            "bin",
            lower.alias("lower"),
            ((F.col("bin") + 1) / bins).alias("upper"),
            "rows",
            (lower >= 0.5).alias("above_threshold"),
        )
    )


def confidence_box(predictions: DataFrame, places: int = 4) -> DataFrame:
    """Box-plot figures of the largest score for toxic and other rows.

    Scores are logged with four places, so counting equal values first leaves at most
    10,001 rows per group; the exact quantiles are taken from those counts.
    """
    group = F.when(F.col("is_toxic"), "Toxic").otherwise("Non-Toxic")
    counts = (
        predictions.filter(F.col("max_probability").isNotNull() & F.col("is_toxic").isNotNull())
        .groupBy(
            group.alias("prediction"),
            round_half_even(F.col("max_probability"), places).alias("value"),
        )
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    quartile = lambda share: F.percentile("value", F.lit(share), F.col("rows"))
    boxes = counts.groupBy("prediction").agg(
        F.sum("rows").alias("rows"),
        F.min("value").alias("minimum"),
        quartile(0.25).alias("q1"),
        quartile(0.5).alias("median"),
        quartile(0.75).alias("q3"),
        F.max("value").alias("maximum"),
        F.collect_list("value").alias("values"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.filter(
        "values", lambda v: (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    )
    return boxes.withColumn("inside", inside).select(
        "prediction", "rows", "minimum", "q1", "median", "q3", "maximum",
        F.array_min("inside").alias("lower_whisker"),
        F.array_max("inside").alias("upper_whisker"),
    )


def length_drift(
    training: DataFrame,
    predictions: DataFrame,
    n: int | None = None,
    seed: int = 42,
    key: str = "comment_id",
    text: str = "comment_text",
    clip: int | None = None,
) -> DataFrame:
    """(source, length): every training length and every inference length.

    Lengths are counted before anything is made of them, so all rows cost little; ``n`` samples the
    training rows.  Logged texts are cut at 100 characters; ``clip=100`` gives the training
    texts the same cut.
    """
    known = training.filter(F.col(text).isNotNull())
    chosen = sample_rows(known, n, seed, key) if n else known
    body = preview(F.col(text), clip) if clip else F.col(text)
    trained = chosen.select(F.lit(TRAINING).alias("source"), text_length(body).alias("length"))
    inferred = predictions.filter(F.col("text_length").isNotNull()).select(
        F.lit(INFERENCE).alias("source"), F.col("text_length").alias("length")
    )
    return trained.unionByName(inferred)


def length_counts(drift: DataFrame) -> DataFrame:
    """(source, length, rows): as many rows as there are distinct lengths."""
    return drift.groupBy("source", "length").agg(F.count(F.lit(1)).alias("rows"))


def _moments(counts: DataFrame, *more: Column) -> DataFrame:
    """Count, mean, standard deviation and quartiles per source, from counted lengths."""
    rows, length = F.col("rows"), F.col("length").cast("double")
    quartile = lambda share: F.percentile("length", F.lit(share), F.col("rows"))
    sums = counts.groupBy("source").agg(
        F.sum("rows").alias("n"),
        (F.sum(length * rows) / F.sum("rows")).alias("mean"),
        quartile(0.25).alias("q1"),
        quartile(0.5).alias("median"),
        quartile(0.75).alias("q3"),
        *more,
    )
    # Squares are taken from the mean; sums of squares would cancel where lengths hardly differ.
    centred = counts.join(F.broadcast(sums.select("source", "mean")), "source")
    squares = centred.groupBy("source").agg(F.sum((length - F.col("mean")) * (length - F.col("mean")) * rows).alias("_off"))
    return (
        sums.join(F.broadcast(squares), "source", "left")
        .withColumn("sd", F.sqrt(F.greatest(F.try_divide("_off", F.col("n") - 1), F.lit(0.0))))
        .drop("_off")
    )


def length_summary(drift: DataFrame) -> DataFrame:
    """Figures per source and, in a third row, inference minus training."""
    figures = ["mean", "sd", "q1", "median", "q3"]
    per_source = _moments(length_counts(drift)).select("source", "n", *figures)
    minus = lambda name: F.max(F.when(F.col("source") == INFERENCE, F.col(name))) - F.max(
        F.when(F.col("source") == TRAINING, F.col(name))
    )
    difference = per_source.agg(*(minus(name).alias(name) for name in ["n", *figures])).select(
        F.lit("Difference").alias("source"), "n", *figures
    )
    return per_source.unionByName(difference)


def length_density(drift: DataFrame, steps: int = 200) -> DataFrame:
    """(source, step, x, density): Gaussian kernel density on a grid both sources share.

    Works on counted lengths.  Bandwidth 1.06 * min(sd, IQR / 1.34) * n^(-1/5); sd where
    the quartiles coincide, 1 where all lengths do.
    """
    counts = length_counts(drift)
    edges = [F.min("length").alias("low"), F.max("length").alias("high")]
    stats = _moments(counts, *edges)
    narrow = (F.col("q3") - F.col("q1")) / 1.34
    spread = (
        F.when(F.least("sd", narrow) > 0, F.least("sd", narrow))
        .when(F.col("sd") > 0, F.col("sd"))
        .otherwise(F.lit(None))
    )
    width = F.coalesce(1.06 * spread * F.pow(F.col("n"), F.lit(-0.2)), F.lit(1.0))
    sized = stats.select("source", "n", "low", "high", width.alias("width"))
    # One row per source, two in all: the grid's ends need both, the join broadcasts both.
    ends = sized.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = ends.select("low").scalar(), ends.select("high").scalar()
    frame = sized.select("source", "n", "width", low.alias("low"), high.alias("high"))
    points = (
        counts.join(F.broadcast(frame), "source")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        .withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / steps)
    )
    z = (F.col("x") - F.col("length")) / F.col("width")
    bump = F.col("rows") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("width") * math.sqrt(2 * math.pi))
    return points.groupBy("source", "step", "x").agg(F.sum(bump).alias("density"))
