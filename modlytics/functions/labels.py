"""Column functions on the six labels, as maps or as flat columns.

They take column names and build one SQL expression each: six labels make long
expressions, which are cheaper to parse once than to assemble call by call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions.values import round_half_even_sql
from modlytics.schema import LABELS


def label_title(name: Column) -> Column:
    """identity_hate -> Identity Hate."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def _literal(value) -> str:
    return "NULL" if value is None else f"{value}D" if isinstance(value, float) else str(value)


def map_get(labels: str, key: str, default) -> Column:
    """Value of ``key``; the default where map, key or value is missing."""
    return F.expr(f"coalesce(try_element_at({labels}, '{key}'), {_literal(default)})")


def flatten_labels(labels: str, suffix: str, default) -> list[Column]:
    """Six flat columns ``<label><suffix>`` out of a label map."""
    return [map_get(labels, label, default).alias(f"{label}{suffix}") for label in LABELS]


def label_map_sql(columns: list[str]) -> str:
    return "map(" + ", ".join(f"'{label}', {name}" for label, name in zip(LABELS, columns)) + ")"


def label_map(columns: list[str]) -> Column:
    """One map out of six flat columns, in label order."""
    return F.expr(label_map_sql(columns))


def is_any_label(flags: list[str]) -> Column:
    return F.expr(" OR ".join(flags))


def label_count(flags: list[str]) -> Column:
    """How many flags are set."""
    return F.expr(" + ".join(f"int({name})" for name in flags))


def max_label_probability(scores: list[str], places: int | None = None) -> Column:
    """Largest score, taken after rounding when ``places`` is given."""
    terms = scores if places is None else [round_half_even_sql(name, places) for name in scores]
    return F.expr(f"greatest({', '.join(terms)})")


def positive_labels(labels: str) -> Column:
    """Comma list of the set labels, in label order."""
    names = ", ".join(f"'{label}'" for label in LABELS)
    return F.expr(
        f"array_join(filter(array({names}), n -> coalesce(try_element_at({labels}, n), false)), ', ')"
    )


def invert_labels_sql(labels: str) -> str:
    return f"transform_values({labels}, (name, value) -> NOT value)"


def invert_labels(labels: str) -> Column:
    return F.expr(invert_labels_sql(labels))


def labels_equal(left: str, right: str) -> Column:
    """Equality of two label maps; Spark does not compare maps directly."""
    return F.expr(
        " AND ".join(
            f"try_element_at({left}, '{label}') <=> try_element_at({right}, '{label}')"
            for label in LABELS
        )
    )
