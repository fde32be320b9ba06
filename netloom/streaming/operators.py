"""Streaming forms built from Spark's own stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import skips_enrichment
from netloom.functions.times import SECOND, slice_of
from netloom.functions.values import severity_name, severity_rank
from netloom.operators.incidents import INTEL, incident_id


def stream_incidents(alerts: DataFrame, window_seconds: float = 180.0) -> DataFrame:
    """Closed incidents: one row per source and silence-bounded session, once the watermark passed it."""
    for name in INTEL:
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast("string"))
    seen = ~skips_enrichment(F.col("_src_ip"))
    us = F.unix_micros(F.col("alert_ts"))
    keyed = alerts.withColumns({
        "src_ip": F.coalesce("_src_ip", F.lit("unknown")), "rank": severity_rank(F.col("severity")), "us": us,
        "intel": F.when(seen, F.struct(us.alias("us"), "alert_id", *INTEL)),
    })
    sessions = keyed.groupBy("src_ip", F.session_window("alert_ts", f"{window_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("rank").alias("rank"), F.max("intel").alias("intel"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return sessions.select(
        incident_id(F.col("src_ip"), F.col("first_us")).alias("incident_id"),
        F.timestamp_micros("first_us").alias("start_time"), F.timestamp_micros("last_us").alias("end_time"),
        "src_ip", "alert_count", severity_name(F.col("rank")).alias("max_severity"), F.lit("closed").alias("status"),
        *[F.col(f"intel.{c}").alias(c) for c in INTEL])


def stream_labels(flows: DataFrame, alerts: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Flow-alert join of two streams, watermarked on ``flow_end`` and ``alert_ts``.

    Every flow leaves once per alert closer than ``seconds`` or, when none came, once as BENIGN. Time is cut into cells of two
    bands, and the cell is part of the key: a flow is in one cell, an alert in the one or two that its band touches, so they meet
    at most once, and a flow is not compared with all alerts that its key has in state.
    """
    band = int(seconds * SECOND)
    cell = lambda us: slice_of(us, max(2 * band, 1))
    a_us, f_us = F.unix_micros("alert_ts"), F.unix_micros("flow_end")
    cells = F.explode(F.array_distinct(F.array(cell(a_us - band + 1), cell(a_us + band - 1)))).alias("a_cell")
    a = alerts.select(*[F.col(c).alias(f"a{c}") for c in ("_src_ip", "_dst_ip", "_dst_port")], "alert_ts", F.col("label").alias("alert_label"), cells)
    f = flows.drop("label")
    gap = F.abs(f_us - a_us)
    near = F.expr(f"alert_ts BETWEEN flow_end - INTERVAL {seconds} SECONDS AND flow_end + INTERVAL {seconds} SECONDS")
    on = (F.col("_src_ip") == F.col("a_src_ip")) & (F.col("_dst_ip") == F.col("a_dst_ip")) & (F.col("_dst_port") == F.col("a_dst_port")) & (cell(f_us) == F.col("a_cell"))
    joined = f.join(a, on & near & (gap < band), "left")
    return joined.select(*f.columns, F.coalesce("alert_label", F.lit("BENIGN")).alias("label"))


def stream_rates(events: DataFrame, ts: str, window: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """Rows and rows per second of each sliding window."""
    w = F.window(ts, window, slide)
    counted = events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    secs = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", F.round(F.col("n") / secs, 6).alias("per_second"))
