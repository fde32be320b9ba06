"""Reporting questions over stored flows and alerts.

Every function works on the whole input. The newest-N reading of a report is a separate step
(:func:`netloom.operators.ranking.newest`), put in front where wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.times import time_bin
from netloom.functions.values import fixed_text, percent_change, percent_text, ratio
from netloom.operators.ranking import newest, top_counts

CRITICAL = ["high", "medium"]


def _n() -> Column:
    return F.count(F.lit(1))


def _pair(kind: str, item: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), item.alias("item"))


def _seconds_before(as_of: Column, seconds: float) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(float(seconds)))


# ---------------------------------------------------------------- rolling and cumulative statistics

def rolling_rates(flows: DataFrame, alerts: DataFrame, as_of: Column, window_seconds: float = 300.0) -> DataFrame:
    """Counts in the last ``window_seconds`` up to ``as_of`` (start included) and rates per second."""
    since = _seconds_before(as_of, window_seconds)
    both = flows.select(F.lit("flow").alias("kind"), F.col("flow_end").alias("ts")).unionByName(
        alerts.select(F.lit("alert").alias("kind"), F.col("alert_ts").alias("ts")))
    recent = both.where((F.col("ts") >= since) & (F.col("ts") <= as_of))
    c = recent.agg(F.count_if(F.col("kind") == "flow").alias("f"), F.count_if(F.col("kind") == "alert").alias("a"))
    return c.select(
        F.lit(float(window_seconds)).alias("window_secs"), F.col("f").alias("flows_in_window"), F.col("a").alias("alerts_in_window"),
        F.round(F.col("f") / F.lit(float(window_seconds)), 2).alias("flows_per_sec"),
        F.round(F.col("a") / F.lit(float(window_seconds)), 3).alias("alerts_per_sec"),
    )


def totals(flows: DataFrame, alerts: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """total_flows, total_alerts, attack_rate_pct and, when given, total_packets."""
    parts = [("flow", flows), ("alert", alerts)] + ([("packet", packets)] if packets is not None else [])
    tagged = None
    for kind, df in parts:
        one = df.select(F.lit(kind).alias("kind"))
        tagged = one if tagged is None else tagged.union(one)
    c = tagged.agg(*[F.count_if(F.col("kind") == k).alias(k) for k, _ in parts])
    cols = [F.col("flow").alias("total_flows"), F.col("alert").alias("total_alerts"),
            F.round(ratio(F.col("alert"), F.col("flow")) * 100, 2).alias("attack_rate_pct")]
    if packets is not None:
        cols.append(F.col("packet").alias("total_packets"))
    return c.select(*cols)


def alert_distributions(alerts: DataFrame) -> DataFrame:
    """(dimension, item, n) for label, severity, source and destination, in one pass."""
    dims = F.array(
        _pair("label", F.coalesce("label", F.lit("UNKNOWN"))),
        _pair("severity", F.coalesce("severity", F.lit("low"))),
        _pair("src_ip", F.coalesce("_src_ip", F.lit("unknown"))),
        _pair("dst_ip", F.coalesce("_dst_ip", F.lit("unknown"))),
    )
    return alerts.select(F.explode(dims).alias("d")).groupBy(F.col("d.kind").alias("dimension"), "d.item").agg(_n().alias("n"))


def port_distribution(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.coalesce("dst_port", F.lit(0)).alias("port")).agg(_n().alias("n"))


def score_summary(alerts: DataFrame, last: int = 1000) -> DataFrame:
    """Count, mean, p90 and p99 of the newest ``last`` alert scores (a ring buffer of that length)."""
    recent = alerts.orderBy(F.col("alert_ts").desc(), F.col("alert_id").desc()).limit(last)
    s = recent.agg(F.array_sort(F.collect_list(F.coalesce("score", F.lit(0.0)))).alias("s"), F.avg(F.coalesce("score", F.lit(0.0))).alias("m"))
    n = F.size("s")

    def at(q):
        return F.round(F.element_at("s", F.floor(n * F.lit(q)).cast("int") + 1), 4)

    zero = F.lit(0.0)
    return s.select(
        n.cast("long").alias("score_count"), F.coalesce(F.round("m", 4), zero).alias("score_mean"),
        F.when(n > 10, at(0.9)).otherwise(zero).alias("score_p90"),
        F.when(n > 100, at(0.99)).otherwise(zero).alias("score_p99"),
    )


def snapshot(flows: DataFrame, alerts: DataFrame, as_of: Column, window_seconds: float = 300.0) -> DataFrame:
    """One row with totals, rolling rates, top lists, count maps and score figures.

    Lists hold 10 and 5 entries; the port map has at most 65,536. Each part is its own scalar
    subquery over a column-pruned scan, so pass stored tables.
    """
    def one(df: DataFrame) -> Column:
        return df.select(F.struct("*")).scalar()

    def as_map(df: DataFrame, key: str) -> Column:
        return df.agg(F.map_from_entries(F.collect_list(F.struct(key, "n")))).scalar()

    def as_list(df: DataFrame, key: str) -> Column:
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("item"))))
        return df.agg(F.transform(ranked, lambda e: F.struct(e["item"].alias(key), (-e["m"]).alias("n")))).scalar()

    spark = flows.sparkSession
    sev = alerts.groupBy(F.coalesce("severity", F.lit("low")).alias("severity")).agg(_n().alias("n"))
    lab = alerts.groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label")).agg(_n().alias("n"))
    return spark.range(1).select(
        one(totals(flows, alerts)).alias("t"), one(rolling_rates(flows, alerts, as_of, window_seconds)).alias("r"),
        one(score_summary(alerts)).alias("s"),
        as_list(top_counts(alerts, "_src_ip", 10), "_src_ip").alias("top_src_ips"),
        as_list(top_counts(alerts, "_dst_ip", 5), "_dst_ip").alias("top_dst_ips"),
        as_map(lab, "label").alias("label_counts"), as_map(sev, "severity").alias("severity_counts"),
        as_map(port_distribution(flows), "port").alias("protocol_counts"),
    ).select("t.*", "r.*", "s.*", "top_src_ips", "top_dst_ips", "label_counts", "severity_counts", "protocol_counts")


# ---------------------------------------------------------------- overview panels

def kpis(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    both = flows.select(F.lit("flow").alias("kind"), F.lit(None).cast("string").alias("severity")).unionByName(
        alerts.select(F.lit("alert").alias("kind"), "severity"))
    c = both.agg(
        F.count_if(F.col("kind") == "flow").alias("total_flows"), F.count_if(F.col("kind") == "alert").alias("total_alerts"),
        F.count_if(F.col("severity").isin(CRITICAL)).alias("critical"))
    rate = F.when(F.col("total_flows") > 0, percent_text(F.col("total_alerts") / F.col("total_flows"), 1))
    return c.select("*", rate.otherwise("0.0%").alias("attack_rate"))


def compare_periods(flows: DataFrame, alerts: DataFrame, as_of: Column, seconds: float = 86400.0) -> DataFrame:
    """(metric, cur, prev, delta_pct) for flows, alerts and high+medium alerts up to ``as_of``, in one pass.

    Each metric has a row, also without any rows to count.
    """
    cut, start = _seconds_before(as_of, seconds), _seconds_before(as_of, 2 * seconds)
    critical = F.col("severity").isin(CRITICAL)
    both = flows.select(F.array(F.lit("flows")).alias("m"), F.col("flow_end").alias("ts")).unionByName(
        alerts.select(F.when(critical, F.array(F.lit("alerts"), F.lit("high"))).otherwise(F.array(F.lit("alerts"))).alias("m"),
                      F.col("alert_ts").alias("ts")))
    c = both.where((F.col("ts") >= start) & (F.col("ts") <= as_of)).select(F.explode("m").alias("metric"), "ts").groupBy("metric").agg(
        F.count_if(F.col("ts") >= cut).alias("cur"), F.count_if(F.col("ts") < cut).alias("prev"))
    every = flows.sparkSession.createDataFrame([("flows",), ("alerts",), ("high",)], "metric string")
    c = every.join(c, "metric", "left").select("metric", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("cur", "prev")])
    return c.select("*", F.round(percent_change(F.col("cur"), F.col("prev")), 4).alias("delta_pct"))


def severity_breakdown(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(_n().alias("n"))


def timeline(alerts: DataFrame, seconds: int = 30, ts: str = "alert_ts") -> DataFrame:
    """(bin, n) over the whole span, empty bins included."""
    counts = alerts.where(F.col(ts).isNotNull() & F.col("severity").isNotNull()).groupBy(time_bin(ts, seconds).alias("bin")).agg(_n().alias("n"))
    return fill_bins(counts, "bin", seconds)


SPINE = 4096  # entries of the longest array that a spine is made of


def fill_bins(counts: DataFrame, column: str, seconds: int) -> DataFrame:
    """Adds the missing bins between the first and the last with n = 0. One row per bin in the span.

    The spine is made in three steps of arrays no longer than ``SPINE`` (a span may have ``SPINE``**3 bins); the fine bins
    of each coarse cell are made, and joined, in parallel. A single stray time costs its empty bins and no more.
    """
    span = counts.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null")
    bins = F.expr(f"timestampdiff(SECOND, a, b) div {int(seconds)}")  # number of the last one

    def upto(last: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.least(last, F.lit(SPINE - 1).cast("long"))))

    coarse = span.select("a", bins.alias("last")).withColumn("i", upto(F.floor(F.col("last") / SPINE**2)))
    cells = coarse.withColumn("j", upto(F.floor((F.col("last") - F.col("i") * SPINE**2) / SPINE))).withColumn("at", (F.col("i") * SPINE + F.col("j")) * SPINE)
    fine = cells.repartition("i", "j").withColumn("k", upto(F.col("last") - F.col("at")))
    spine = fine.select(F.expr(f"a + make_dt_interval(0, 0, 0, cast((at + k) * {int(seconds)} AS decimal(18, 6)))").alias(column))
    return spine.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def heatmap(alerts: DataFrame, ts: str = "alert_ts") -> DataFrame:
    """Day of week by hour of day (24 columns), Monday first, only days that occur."""
    cells = alerts.select(F.weekday(ts).alias("w"), F.date_format(ts, "EEEE").alias("day"), F.hour(ts).alias("h"))
    hours = [F.count_if(F.col("h") == h).alias(f"h{h:02d}") for h in range(24)]
    return cells.groupBy("w", "day").agg(*hours).orderBy("w").drop("w")


def score_histogram(flows: DataFrame, bins: int = 60, column: str = "score") -> DataFrame:
    """(bin, lower, n) over [0, 1], every bin present; 1.0 falls into the last."""
    index = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = flows.where(F.col(column).between(0, 1)).groupBy(index.alias("bin")).agg(_n().alias("n"))
    spine = flows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", F.round(F.col("bin") / F.lit(float(bins)), 6).alias("lower"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def geo_hotspots(alerts: DataFrame) -> DataFrame:
    """Alerts per place; rows without coordinates (or at zero) are not on the map."""
    placed = alerts.where((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0))
    keys = [F.col("_src_ip").alias("ip"), "lat", "lon", F.coalesce("country", F.lit("Unknown")).alias("location"),
            F.coalesce("severity", F.lit("low")).alias("severity"), F.coalesce("isp", F.lit("Unknown")).alias("isp")]
    return placed.groupBy(*keys).agg(_n().alias("alerts"))


def traffic_links(flows: DataFrame) -> DataFrame:
    return flows.groupBy("_src_ip", "_dst_ip").agg(_n().alias("value"))


def top_traffic_links(flows: DataFrame, n: int = 6) -> DataFrame:
    """Links whose source is among the ``n`` busiest sources and target among the busiest targets."""
    links = traffic_links(flows)

    def busiest(column):
        sums = links.groupBy(column).agg(F.sum("value").alias("_v"))
        return sums.orderBy(F.col("_v").desc(), F.col(column)).limit(n).select(column)

    return links.join(busiest("_src_ip"), "_src_ip", "left_semi").join(busiest("_dst_ip"), "_dst_ip", "left_semi").select("_src_ip", "_dst_ip", "value")


def link_nodes(links: DataFrame) -> DataFrame:
    """(node, node_id): distinct ends of a link table cut to the top links, numbered by name."""
    nodes = links.select(F.col("_src_ip").alias("node")).union(links.select(F.col("_dst_ip"))).distinct()
    names = nodes.agg(F.array_sort(F.collect_list("node")).alias("names"))
    return names.select(F.posexplode("names").alias("node_id", "node")).select("node", "node_id")


def indexed_links(links: DataFrame) -> DataFrame:
    """Link table with node numbers in place of addresses; takes the cut table (2 n nodes at most)."""
    nodes = link_nodes(links)
    src = nodes.select(F.col("node").alias("_src_ip"), F.col("node_id").alias("source"))
    dst = nodes.select(F.col("node").alias("_dst_ip"), F.col("node_id").alias("target"))
    return links.join(src, "_src_ip").join(dst, "_dst_ip").select("source", "target", "value")


def run_summary(flows: DataFrame, alerts: DataFrame, top: int = 5) -> DataFrame:
    """(kind, item, n): flows, alerts, alerts by severity and by rule name, top sources."""
    rule = F.split_part("signature_match", F.lit(":"), F.lit(1))
    dims = F.filter(F.array(
        _pair("total", F.lit("alerts")),
        _pair("severity", F.coalesce("severity", F.lit("low"))),
        F.when(F.col("signature_match") != "", _pair("rule", rule)),
    ), lambda d: d.isNotNull())
    by = alerts.select(F.explode(dims).alias("d")).groupBy("d.kind", "d.item").agg(_n().alias("n"))
    total = flows.agg(_n().alias("n")).select(F.lit("total").alias("kind"), F.lit("flows").alias("item"), "n")
    src = alerts.select(F.coalesce("_src_ip", F.lit("?")).alias("item"))
    sources = top_counts(src, "item", top).select(F.lit("source").alias("kind"), "item", "n")
    return by.unionByName(total).unionByName(sources)


# ---------------------------------------------------------------- alert tables

def filter_severity(alerts: DataFrame, severities: Sequence[str], limit: int = 2000) -> DataFrame:
    """The newest ``limit`` alerts, then those of the given severities (in this order of steps)."""
    return newest(alerts, limit, "alert_ts", "alert_id").where(F.col("severity").isin(list(severities)))


def alert_table(alerts: DataFrame) -> DataFrame:
    """Export form: formatted time, rounded score, newest first."""
    cols = ["severity", "_src_ip", "_src_port", "_dst_ip", "_dst_port", "score", "label", "signature_match", "suppression_note"]
    rows = alerts.select("alert_id", F.date_format("alert_ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
                         *[F.round("score", 3).alias("score") if c == "score" else c for c in cols if c in alerts.columns])
    return rows.orderBy(F.col("time").desc(), F.col("alert_id").desc())


def alert_ticker(alerts: DataFrame, n: int = 8) -> DataFrame:
    text = F.nullif(F.trim("signature_match"), F.lit(""))
    message = F.when(text.isNotNull() & (text != "nan"), F.col("signature_match")).otherwise(
        F.concat(F.lit("Anomaly: "), fixed_text(F.coalesce("score", F.lit(0.0)), 3)))
    rows = alerts.orderBy(F.col("alert_ts").desc(), F.col("alert_id").desc()).limit(n)
    return rows.select("alert_id", F.upper(F.coalesce("severity", F.lit("low"))).alias("severity"), F.substring(message, 1, 50).alias("message"))


def inspect_alert(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id).withColumns({
        "ensemble_score": percent_text(F.col("score")), "rf_confidence": percent_text(F.col("rf_score")),
        "anomaly_score": percent_text(F.col("ae_score")),
    })


def console_lines(alerts: DataFrame) -> DataFrame:
    """One log line per alert, as the console and the live view show it."""
    line = F.format_string(
        "[ALERT] %s | %s:%s → %s:%s | score=%s | label=%s",
        F.upper(F.coalesce("severity", F.lit("?"))), F.col("_src_ip"), F.col("_src_port"), F.col("_dst_ip"), F.col("_dst_port"),
        fixed_text(F.coalesce("score", F.lit(0.0)), 3), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("?")))
    live = F.format_string(
        "[%s] %s | %s -> %s (%s)", F.date_format("alert_ts", "HH:mm:ss"), F.coalesce("label", F.lit("ALERT")),
        F.coalesce("_src_ip", F.lit("?")), F.coalesce("_dst_ip", F.lit("?")), F.coalesce("signature_match", F.lit("Unknown Sig")))
    return alerts.select("alert_id", line.alias("line"), live.alias("live_line"))
