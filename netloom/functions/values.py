"""Scalar cleaning, arithmetic and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}


def finite_or(c: Column, default: float) -> Column:
    """The value, with NULL, NaN and both infinities replaced.

    NaN sorts above infinity and NULL compares to NULL, so one comparison finds all of them.
    """
    c = c.cast("double")
    return F.when(F.abs(c) < INF, c).otherwise(F.lit(float(default)))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def ratio(num: Column, den: Column, floor: float = 1.0) -> Column:
    """num / max(den, floor): never divides by zero."""
    return num / F.greatest(den.cast("double"), F.lit(float(floor)))


def percent_change(cur: Column, prev: Column) -> Column:
    grown = F.when(cur > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(prev == 0, grown).otherwise(F.try_divide((cur - prev) * F.lit(100.0), prev))


def truthy(*cols: Column, kind: str = "string") -> Column:
    """First argument that is neither NULL nor the type's empty value ('' or 0)."""
    empty = F.lit("") if kind == "string" else F.lit(0)
    return F.coalesce(*[F.nullif(c, empty) for c in cols])


def severity_rank(sev: Column) -> Column:
    out = F.when(sev == "high", F.lit(2)).when(sev == "medium", F.lit(1))
    return out.otherwise(F.lit(0))


def severity_name(rank: Column) -> Column:
    return F.when(rank == 2, "high").when(rank == 1, "medium").otherwise("low")


def fixed_text(c: Column, digits: int) -> Column:
    """Fixed-point text rounded from the exact binary value, ties to even."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def percent_text(c: Column, digits: int = 2) -> Column:
    return F.concat(fixed_text(F.coalesce(c, F.lit(0.0)) * 100.0, digits), F.lit("%"))


def fingerprint(*cols: Column) -> Column:
    """Pipe-joined key; a missing part reads ``?``."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("?")) for c in cols])


def md5_number(*parts: Column) -> Column:
    """60-bit non-negative id from the md5 of the pipe-joined parts; the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")
