"""Alerts of one source -> incidents.

Same two steps as flow building: alerts are first combined per source and time slice (a slice is no
longer than the inactivity window, so it never holds a break), then the slices of a source are cut
where the silence is too long. A source brings one row per slice into the second step, however many
alerts it raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.net import skips_enrichment
from netloom.functions.times import micros, slice_of, to_micros
from netloom.functions.values import md5_number, severity_name, severity_rank
from netloom.schemas import INCIDENT_SCHEMA

INTEL = ["country", "city", "asn", "threat_level"]


def _keyed(alerts: DataFrame, slice_us: int) -> DataFrame:
    us = micros(alerts, "alert_ts")
    return alerts.withColumns({
        "src_ip": F.coalesce("_src_ip", F.lit("unknown")), "_us": us, "_slice": slice_of(us, slice_us),
    })


def _slices(alerts: DataFrame, gap_us: int, slice_us: int) -> DataFrame:
    """One row per (source, slice) with the incident it belongs to."""
    for name in INTEL:
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast("string"))
    keyed = _keyed(alerts, slice_us)
    seen = ~skips_enrichment(F.col("_src_ip"))
    newest = F.when(seen, F.struct("_us", "alert_id", *INTEL))
    slices = keyed.groupBy("src_ip", "_slice").agg(
        F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"),
        F.min("_us").alias("first_us"), F.max("_us").alias("last_us"),
        F.min("alert_ts").alias("first_ts"), F.max("alert_ts").alias("last_ts"),
        F.max(newest).alias("intel"),
    )
    by_src = Window.partitionBy("src_ip").orderBy("_slice")
    lead = F.col("first_us") - F.lag("last_us").over(by_src)
    opens = F.coalesce(lead > gap_us, F.lit(True))
    return (
        slices.withColumn("opens", opens.cast("long"))
        .withColumn("session", F.sum("opens").over(by_src.rowsBetween(Window.unboundedPreceding, 0)))
    )


def _limits(window_seconds: float) -> tuple[int, int]:
    gap_us = to_micros(window_seconds)
    return gap_us, min(gap_us, to_micros(180))


def incident_id(src: Column, start_us: Column) -> Column:
    return md5_number(src, start_us)


def correlate(alerts: DataFrame, window_seconds: float = 180.0, as_of: Column | None = None) -> DataFrame:
    """Incidents of the alerts; ``status`` is told at ``as_of`` (default: the newest alert)."""
    gap_us, slice_us = _limits(window_seconds)
    sessions = (
        _slices(alerts, gap_us, slice_us).groupBy("src_ip", "session").agg(
            F.sum("n").alias("alert_count"), F.max("rank").alias("rank"),
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
            F.min("first_ts").alias("start_time"), F.max("last_ts").alias("end_time"),
            F.max("intel").alias("intel"),
        )
    )
    if as_of is None:
        as_of = alerts.agg(F.max("alert_ts")).scalar()
    idle = F.timestamp_diff("MICROSECOND", F.col("end_time"), as_of)
    return sessions.select(
        incident_id(F.col("src_ip"), F.col("first_us")).alias("incident_id"),
        "start_time", "end_time", "src_ip", "alert_count",
        severity_name(F.col("rank")).alias("max_severity"),
        F.when(idle > gap_us, "closed").otherwise("active").alias("status"),
        *[F.col(f"intel.{c}").alias(c) for c in INTEL],
    ).select(*[f.name for f in INCIDENT_SCHEMA])


def assign_incidents(alerts: DataFrame, window_seconds: float = 180.0) -> DataFrame:
    """Adds ``incident_id`` to every alert.

    The lookup side has one row per source and slice. Should one slice of one source hold very many
    alerts, AQE splits that partition of the alert side.
    """
    gap_us, slice_us = _limits(window_seconds)
    slices = _slices(alerts, gap_us, slice_us)
    session = Window.partitionBy("src_ip", "session").orderBy("_slice")
    opened = F.first("first_us").over(session.rowsBetween(Window.unboundedPreceding, 0))
    lookup = slices.select("src_ip", "_slice", incident_id(F.col("src_ip"), opened).alias("incident_id"))
    keyed = _keyed(alerts.drop("incident_id"), slice_us)
    return keyed.join(lookup, ["src_ip", "_slice"]).drop("src_ip", "_slice", "_us")


def incident_rows(incidents: DataFrame) -> DataFrame:
    """Reading form: place, length in words, malicious mark."""
    from netloom.functions.times import uptime_text

    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / F.lit(1e6)
    city = F.nullif(F.col("city"), F.lit(""))
    country = F.coalesce("country", F.lit("Unknown"))
    return incidents.select(
        "incident_id", "src_ip", "alert_count",
        F.when(city.isNotNull(), F.concat_ws(", ", city, country)).otherwise(country).alias("location"),
        F.upper("max_severity").alias("severity"), F.initcap("status").alias("status"),
        F.when(seconds > 0, uptime_text(seconds)).otherwise("Instant").alias("duration"),
        (F.coalesce(F.col("threat_level"), F.lit("")) == "high").alias("malicious"),
        F.col("asn").alias("organization"),
    )
