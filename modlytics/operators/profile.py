"""Profile and validate comment tables and scoring requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions.text import clean_text
from modlytics.functions.values import rows_of
from modlytics.schema import LABELS

# Request limits of the scoring service.
MIN_TEXT, MAX_TEXT = 1, 5000


def require_columns(df: DataFrame, names=LABELS) -> DataFrame:
    """The frame itself, or an error naming the absent label columns."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"Missing target columns: {absent}")
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, in one pass."""
    counted = df.agg(*(F.expr(f"count_if(`{name}` IS NULL)").alias(name) for name in df.columns))
    return rows_of(
        counted, *({"column_name": f"'{name}'", "null_count": f"`{name}`"} for name in df.columns)
    )


def dataset_shape(df: DataFrame) -> DataFrame:
    columns = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(columns))


def label_statistics(df: DataFrame, labels=LABELS) -> DataFrame:
    """Rate and count of positives per label, all labels in one pass."""
    sums = [f"coalesce(sum(bigint({label})), 0L) AS {label}_sum" for label in labels]
    known = [f"count({label}) AS {label}_known" for label in labels]
    counted = df.agg(*(F.expr(sql) for sql in ["count(1) AS n", *sums, *known]))
    return rows_of(
        counted,
        *(
            {
                "label": f"'{label}'",
                "positive_rate": f"try_divide({label}_sum, {label}_known)",
                "positive_count": f"{label}_sum",
                "total_count": "n",
            }
            for label in labels
        ),
    )


def prepare_dataset(df: DataFrame, text: str = "comment_text") -> DataFrame:
    """Cleaned text and the label array beside the input columns."""
    require_columns(df)
    labels = F.array(*(F.col(label).cast("int") for label in LABELS))
    return df.withColumn("clean_text", clean_text(F.col(text))).withColumn("labels", labels)


def dataset_profile(df: DataFrame) -> DataFrame:
    """Shape, nulls and label statistics as (section, name, metric, value) rows, in one pass."""
    sums = [F.sum(F.col(label).cast("bigint")).alias(f"{label}_sum") for label in LABELS]
    nulls = [F.expr(f"count_if(`{name}` IS NULL)").alias(f"{name}_null") for name in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("n"), *nulls, *sums)
    entry = lambda section, name, metric, value: {
        "section": f"'{section}'", "name": f"'{name}'", "metric": f"'{metric}'", "value": f"double({value})"
    }
    rows = [entry("shape", "dataset", "row_count", "n"), entry("shape", "dataset", "column_count", len(df.columns))]
    rows += [entry("missing_values", name, "null_count", f"`{name}_null`") for name in df.columns]
    for label in LABELS:
        known, positive = f"(n - `{label}_null`)", f"coalesce({label}_sum, 0L)"
        rows += [
            entry("label_statistics", label, "positive_rate", f"try_divide({positive}, {known})"),
            entry("label_statistics", label, "positive_count", positive),
            entry("label_statistics", label, "total_count", "n"),
        ]
    return rows_of(counted, *rows)


def validation_report(
    features: DataFrame, labels: DataFrame, key: str = "comment_id", label_columns=LABELS
) -> DataFrame:
    """One row: sizes of both sides and the rows without a partner on the other.

    Each side is counted per key first, so a repeated key is one row of the join; of its rows,
    those have no partner that the other side has fewer of.  A null key has none.
    """
    present = [name for name in label_columns if name in labels.columns]
    left = features.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    right = labels.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    here, there = F.coalesce("l", F.lit(0).cast("bigint")), F.coalesce("r", F.lit(0).cast("bigint"))
    total = lambda value: F.coalesce(F.sum(value), F.lit(0).cast("bigint"))
    return left.join(right, key, "full").agg(
        total(here).alias("feature_rows"),
        total(there).alias("label_rows"),
        total(F.greatest(here - there, F.lit(0))).alias("features_without_labels"),
        total(F.greatest(there - here, F.lit(0))).alias("labels_without_features"),
    ).withColumn("label_columns", F.lit(len(present)))


def validate_training(
    features: DataFrame | None, labels: DataFrame | None, key: str = "comment_id"
) -> None:
    """Raise where training input is missing, empty, unmatched or not six labels wide."""
    if features is None or labels is None:
        raise ValueError("Input features and labels cannot be None")
    report = validation_report(features, labels, key).first()
    if report.feature_rows == 0 or report.label_rows == 0:
        raise ValueError("Input features and labels cannot be empty")
    nameless = features.filter(F.col(key).isNull()).limit(1).count() + labels.filter(F.col(key).isNull()).limit(1).count()
    if nameless:
        raise ValueError(f"Features and labels must have a {key}, some have none")
    if report.features_without_labels or report.labels_without_features:
        raise ValueError(
            "Features and labels must have same length: "
            f"{report.feature_rows} vs {report.label_rows}"
        )
    if report.label_columns != len(LABELS):
        raise ValueError(f"Labels must have {len(LABELS)} columns, got {report.label_columns}")


def request_problems(
    text: str = "text", required: tuple[str, ...] = (), shares: tuple[str, ...] = ()
) -> Column:
    """Array of rule names a request row breaks; empty when it is valid."""
    size = F.length(F.col(text))
    rules = [
        F.when(F.col(text).isNull(), F.lit("text_missing")),
        F.when(size < MIN_TEXT, F.lit("text_too_short")),
        F.when(size > MAX_TEXT, F.lit("text_too_long")),
    ]
    rules += [F.when(F.col(name).isNull(), F.lit(f"{name}_missing")) for name in required]
    rules += [
        F.when(~F.col(name).between(0.0, 1.0), F.lit(f"{name}_out_of_range")) for name in shares
    ]
    return F.array_compact(F.array(*rules))


def validate_requests(
    df: DataFrame,
    text: str = "text",
    required: tuple[str, ...] = (),
    shares: tuple[str, ...] = (),
) -> DataFrame:
    """Every request with ``reasons`` and ``valid``; nothing is dropped."""
    return df.withColumn("reasons", request_problems(text, required, shares)).withColumn(
        "valid", F.size("reasons") == 0
    )
