"""Rounding, timestamps and small reshaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_even(value: Column, places: int = 4) -> Column:
    """Scale, round to the even neighbour, scale back: 0.0625 at three places is 0.062.

    ``bround`` works on the shortest decimal form of a double instead, and so sees ties
    in values that are not halfway in binary.
    """
    scale = float(10**places)
    return F.rint(value * scale) / scale


def round_half_even_sql(value: str, places: int) -> str:
    return f"rint(({value}) * 1e{places}) / 1e{places}"


def parse_ts(text: Column) -> Column:
    """Text to a timestamp, row by row; text without a zone is UTC, null where no known format fits."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") | ~F.contains(text, F.lit(":"))
    return F.coalesce(
        F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ss,SSSX")),
        F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))),
    )


def in_utc(ts: Column) -> Column:
    """The timestamp whose figures in the session's zone are those of ``ts`` in UTC."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def iso_utc(ts: Column) -> Column:
    """Timestamp as the ISO text log records carry."""
    return F.concat(F.date_format(in_utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def event_date(ts: Column) -> Column:
    """Calendar day in UTC."""
    return F.to_date(in_utc(ts))


def percent(share: Column) -> Column:
    """A share as text with two decimals and a percent sign."""
    return F.concat(F.format_number(share * 100, 2), F.lit("%"))


def rows_of(df: DataFrame, *rows: dict[str, str]) -> DataFrame:
    """Turn each row of ``df`` into one row per given dict of SQL expressions.

    Used on one-row aggregates: all labels are counted in a single pass over the
    data and only the finished numbers are laid out as rows.
    """
    structs = [
        "struct(" + ", ".join(f"{sql} AS {name}" for name, sql in row.items()) + ")" for row in rows
    ]
    return df.selectExpr(f"inline(array({', '.join(structs)}))")
