"""Scalar expressions of the event pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), c) * 1000).cast("long")


def window_id(millis: Column, span_ms: int) -> Column:
    """Number of the tumbling window that holds a time; integer arithmetic, also before 1970."""
    return ((millis - F.pmod(millis, F.lit(span_ms))) / F.lit(span_ms)).cast("long")


def campaign_number(uuid: str | Column) -> Column:
    """First eight hex digits of a UUID as a bigint."""
    c = F.col(uuid) if isinstance(uuid, str) else uuid
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("long")


def times_ten(column: str | Column) -> Column:
    """The value function of the map stage."""
    return (F.col(column) if isinstance(column, str) else column) * 10


def money_sum(column: Column, precision: int = 18, scale: int = 2) -> Column:
    """Sum through decimals, so that it doesn't depend on the order of rows."""
    return F.sum(column.cast(f"decimal({precision},{scale})")).cast("double")
