"""Time helpers that treat TIMESTAMP and TIMESTAMP_NTZ alike."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch as bigint. NTZ values are read as UTC (pin the session to UTC)."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def to_micros(seconds: float) -> int:
    return int(round(seconds * SECOND))


def slice_of(us: Column, width_us: int) -> Column:
    """Start of the fixed-width time slice that holds ``us`` (floor, also before the epoch)."""
    return us - F.pmod(us, F.lit(width_us).cast("long"))


def time_bin(name: str, seconds: int) -> Column:
    """Start of the tumbling bin of ``seconds`` that holds the timestamp."""
    return F.window(F.col(name), f"{seconds} seconds")["start"]


def uptime_text(seconds: Column) -> Column:
    """``1h 2m 3s`` / ``2m 3s`` / ``3s``, whole seconds, leading zero units left out."""
    whole = F.floor(seconds).cast("long")
    hours = F.floor(whole / 3600).cast("long")
    mins = F.floor((whole % 3600) / 60).cast("long")
    secs = whole % 60
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, mins, secs))
        .when(mins > 0, F.format_string("%dm %ds", mins, secs))
        .otherwise(F.format_string("%ds", secs))
    )
