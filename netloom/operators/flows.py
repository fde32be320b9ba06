"""Packets -> bidirectional flows.

A flow is a run of packets with the same unordered pair of endpoints and protocol in which no two
neighbours are more than ``gap`` apart. Three aggregations of falling size build it:

1. *ticks*: packets with the same key and microsecond are combined (map side first), so copies of a
   packet never travel one by one;
2. *slices*: ticks of one key inside one fixed time slice. A slice is no longer than the gap, so it
   can never hold a session break, and a key is spread over as many groups as it has slices. A group
   holds at most one tick per microsecond of the slice, however busy the key is;
3. *sessions*: slices of one key in time order, one row per key and slice, cut where the gap to the
   previous slice is too long.

All three work on plain numbers, so Spark can use hash aggregation throughout. The first packet and
the first SYN of a group travel as one bigint: packet id, then one bit telling which endpoint sent
it, then one bit telling whether it opens a connection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.net import with_direction
from netloom.functions.times import SECOND, micros, slice_of, to_micros
from netloom.schemas import FLOW_SCHEMA

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]
FLAGS = ["fin", "syn", "rst", "psh", "ack"]
MAX_SLICE_SECONDS = 60.0

_SUMS = ["n", "n_lo", "len_all", "len_lo", "len_sq"] + FLAGS
_MAXES = ["max_lo", "max_hi"]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds the unordered endpoint pair; ``src_is_lo`` tells which side sent the packet."""
    src, dst = F.coalesce("src_ip", F.lit("")), F.coalesce("dst_ip", F.lit(""))
    sport, dport = F.coalesce("src_port", F.lit(0)), F.coalesce("dst_port", F.lit(0))
    src_is_lo = (src < dst) | ((src == dst) & (sport <= dport))
    return packets.withColumns({
        "src_is_lo": src_is_lo,
        "lo_ip": F.when(src_is_lo, src).otherwise(dst),
        "lo_port": F.when(src_is_lo, sport).otherwise(dport),
        "hi_ip": F.when(src_is_lo, dst).otherwise(src),
        "hi_port": F.when(src_is_lo, dport).otherwise(sport),
        "protocol": F.coalesce("protocol", F.lit(0)),
    })


def _measures(packets: DataFrame, *extra: str) -> DataFrame:
    """One row per packet with the numbers every later step needs, and nothing else."""
    keyed = with_flow_key(packets)
    opens = (F.coalesce("syn", F.lit(0)) == 1) & (F.coalesce("ack", F.lit(0)) == 0)
    code = (
        F.col("packet_id") * 4 + F.col("src_is_lo").cast("long") * 2 + opens.cast("long")
    )
    size = F.coalesce("ip_len", F.lit(0)).cast("long")
    from_lo = F.coalesce("src_ip", F.lit("")) == F.col("lo_ip")
    return keyed.select(
        *KEY, *extra,
        micros(packets, "ts").alias("us"),
        code.alias("code"),
        F.when(opens, code).alias("syn_code"),
        F.lit(1).cast("long").alias("n"),
        from_lo.cast("long").alias("n_lo"),
        size.alias("len_all"),
        F.when(from_lo, size).otherwise(0).alias("len_lo"),
        (size * size).alias("len_sq"),
        F.when(from_lo, size).otherwise(0).alias("max_lo"),
        F.when(from_lo, 0).otherwise(size).alias("max_hi"),
        *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in FLAGS],
    )


def _totals() -> list[Column]:
    return [F.sum(c).alias(c) for c in _SUMS] + [F.max(c).alias(c) for c in _MAXES]


def _ticks(measures: DataFrame, slice_us: int) -> DataFrame:
    # Between equal addresses the order of packets decides their direction, so these stay apart.
    apart = F.when(F.col("lo_ip") == F.col("hi_ip"), F.col("code"))
    return (
        measures.withColumns({"slice": slice_of(F.col("us"), slice_us), "apart": apart})
        .groupBy(*KEY, "slice", "us", "apart")
        .agg(*_totals(), F.min("code").alias("code"), F.min("syn_code").alias("syn_code"))
        .drop("apart")
    )


def _slices(ticks: DataFrame) -> DataFrame:
    """One row per key and slice.

    The tick with the slice's first SYN is kept apart (``syn_*``): if the flow turns around there,
    the wait before that packet does not count as an inter-arrival time.
    """
    order = Window.partitionBy(*KEY, "slice").orderBy("us", "code")
    timed = ticks.withColumns({
        "wait": F.col("us") - F.lag("us").over(order),
        "syn_rank": F.count("syn_code").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    }).withColumn("syn_tick", F.col("syn_code").isNotNull() & (F.col("syn_rank") == 1))

    plain, early = ~F.col("syn_tick"), F.col("syn_rank") == 0
    wait, head = F.col("wait"), F.col("wait").isNull()
    tied = F.when(F.col("n") > 1, F.lit(0).cast("long"))
    wait_s = wait.cast("double") / SECOND
    return timed.groupBy(*KEY, "slice").agg(
        *_totals(),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.min(F.when(head, F.col("code"))).alias("head_code"),
        F.min(F.when(head & plain, tied)).alias("head_tied"),
        F.sum(F.when(plain, wait_s * wait_s)).alias("iat_sq"),
        F.max(F.when(plain, wait)).alias("iat_max"),
        F.min(F.when(plain & ~head, F.coalesce(tied, wait))).alias("iat_min"),
        F.max(F.col("syn_tick") & head).alias("syn_heads"),
        F.min(F.when(F.col("syn_tick"), F.col("syn_code"))).alias("syn_code"),
        F.min(F.when(F.col("syn_tick"), F.col("n"))).alias("syn_n"),
        F.min(F.when(F.col("syn_tick"), wait)).alias("syn_wait"),
        F.max(F.col("syn_tick") & (F.col("syn_code") == F.col("code"))).alias("syn_leads"),
        # What came before the slice's first SYN, for flows between equal addresses.
        F.sum(F.when(early, F.col("n"))).alias("early_n"), F.sum(F.when(early, F.col("len_all"))).alias("early_len"),
        F.max(F.when(early, F.col("max_lo"))).alias("early_max"), F.max(F.when(~early, F.col("max_lo"))).alias("late_max"),
    )


def _sessions(slices: DataFrame, gap_us: int, orient: str) -> DataFrame:
    """One row per flow; each key brings at most one row per slice into this step."""
    by_key = Window.partitionBy(*KEY).orderBy("slice")
    before = F.lag("last_us").over(by_key)
    cut = slices.withColumn("lead", F.col("first_us") - before)
    cut = cut.withColumn("starts", (F.col("lead").isNull() | (F.col("lead") > gap_us)).cast("long"))
    cut = cut.withColumns({
        "session": F.sum("starts").over(by_key.rowsBetween(Window.unboundedPreceding, 0)),
        "lead": F.when(F.col("starts") == 0, F.col("lead")),
    })

    in_flow = Window.partitionBy(*KEY, "session").orderBy("slice")
    upto = in_flow.rowsBetween(Window.unboundedPreceding, 0)
    flagged = cut.withColumns({
        "flow_code": F.first("head_code").over(upto),
        "syn_slices": F.count("syn_code").over(upto),
    })
    turn = (
        F.col("syn_code").isNotNull() & (F.col("syn_slices") == 1)
        & (F.col("flow_code").bitwiseAND(F.lit(1).cast("long")) == 0)
    )
    flagged = flagged.withColumn("turn", turn)

    # The tick with the first SYN may be the slice's first one; its wait then spans two slices.
    syn_wait = F.when(F.col("syn_heads"), F.col("lead")).otherwise(F.col("syn_wait"))
    skipped = F.col("turn") & F.col("syn_leads")
    syn_counted = F.when(~skipped, syn_wait)
    ties_left = F.col("syn_n") - F.when(F.col("turn") & ~F.col("syn_leads"), 2).otherwise(1)
    syn_min = F.when(F.col("syn_code").isNotNull(), F.when(ties_left > 0, F.lit(0).cast("long")).otherwise(syn_counted))
    head_wait = F.when(~F.col("syn_heads"), F.col("lead"))
    waiting = F.col("syn_slices") == 0
    square = lambda c: F.coalesce(F.pow(c.cast("double") / SECOND, F.lit(2.0)), F.lit(0.0))

    return (
        flagged.withColumns({
            "sq": F.coalesce("iat_sq", F.lit(0.0)) + square(syn_counted) + square(head_wait),
            "hi": F.greatest(F.col("iat_max"), syn_counted, head_wait),
            "lo": F.least(F.col("iat_min"), F.coalesce(F.col("head_tied"), head_wait), syn_min),
            "skip": F.when(skipped, syn_wait),
            "turn_code": F.when(F.col("turn"), F.col("syn_code")),
            "before_n": F.when(waiting, F.col("n")).when(F.col("turn"), F.col("early_n")),
            "before_len": F.when(waiting, F.col("len_all")).when(F.col("turn"), F.col("early_len")),
            "before_max": F.when(waiting, F.col("max_lo")).when(F.col("turn"), F.col("early_max")),
            "after_max": F.when(F.col("turn"), F.col("late_max")).when(~waiting, F.col("max_lo")),
        })
        .groupBy(*KEY, "session")
        .agg(
            *_totals(),
            F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
            F.min("flow_code").alias("flow_code"), F.min("turn_code").alias("turn_code"),
            F.sum("sq").alias("iat_sq"), F.max("hi").alias("iat_max"), F.min("lo").alias("iat_min"),
            F.sum("skip").alias("skipped_us"),
            F.sum("before_n").alias("before_n"), F.sum("before_len").alias("before_len"),
            F.max("before_max").alias("before_max"), F.max("after_max").alias("after_max"),
        )
        .withColumn("src_lo", _source_side(orient))
    )


def _source_side(orient: str) -> Column:
    """True when the low endpoint is the flow's source."""
    first = F.col("flow_code").bitwiseAND(F.lit(2).cast("long")) != 0
    if orient == "first_syn":
        # A late opening packet turns the flow around once, whoever sent it.
        return F.when(F.col("turn_code").isNotNull(), ~first).otherwise(first)
    if orient == "syn_sender":
        opener = F.col("turn_code").bitwiseAND(F.lit(2).cast("long")) != 0
        return F.coalesce(opener, first)
    raise ValueError(f"orient must be 'first_syn' or 'syn_sender', not {orient!r}")


def _features(sessions: DataFrame, home_nets: Iterable[str], ntz: bool, orient: str = "first_syn") -> DataFrame:
    src_lo = F.col("src_lo")
    # Direction of a packet is told by address alone, so with equal addresses all count as forward; when such
    # a flow turns around, what was counted so far changes sides.
    same = F.col("lo_ip") == F.col("hi_ip")
    fwd_lo = src_lo | same
    swapped = same & F.col("turn_code").isNotNull() & F.lit(orient == "first_syn")

    def pick(cond, a, b):
        return F.when(cond, a).otherwise(b)

    n = F.col("n")
    span_us = F.col("last_us") - F.col("first_us")
    duration = F.when(span_us > 0, span_us / float(SECOND)).otherwise(F.lit(1e-6))
    total = F.col("len_all").cast("double")
    mean_len = total / n
    var_len = F.col("len_sq") / n - mean_len * mean_len
    waits = F.greatest(n - 1, F.lit(1))
    iat_mean = (span_us - F.coalesce("skipped_us", F.lit(0))) / float(SECOND) / waits
    iat_var = F.col("iat_sq") / waits - iat_mean * iat_mean
    zero = F.lit(0.0)
    before_n, before_len = (F.coalesce(c, F.lit(0).cast("long")) for c in ("before_n", "before_len"))

    def split(turned, lo_is_fwd, hi_is_fwd):
        return F.when(swapped, turned).otherwise(pick(fwd_lo, lo_is_fwd, hi_is_fwd))

    src_ip, dst_ip = pick(src_lo, F.col("lo_ip"), F.col("hi_ip")), pick(src_lo, F.col("hi_ip"), F.col("lo_ip"))
    dst_port = pick(src_lo, F.col("hi_port"), F.col("lo_port"))

    def stamp(c):
        out = F.timestamp_micros(c)
        if ntz:
            return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({c}/1000000 as decimal(18,6)))")
        return out

    out = sessions.where(n >= 2).select(
        F.shiftright("flow_code", 2).alias("flow_id"),
        dst_port.alias("dst_port"),
        F.round(duration, 6).alias("duration"),
        split(F.col("len_all") - before_len, F.col("len_lo"), F.col("len_all") - F.col("len_lo")).cast("double").alias("src_bytes"),
        split(before_len, F.col("len_all") - F.col("len_lo"), F.col("len_lo")).cast("double").alias("dst_bytes"),
        n.alias("packet_count"),
        mean_len.alias("avg_packet_len"),
        F.sqrt(F.greatest(var_len, zero)).alias("std_packet_len"),
        (total / duration).alias("flow_bytes_per_sec"),
        (n / duration).alias("flow_packets_per_sec"),
        split(F.coalesce("after_max", zero), F.col("max_lo"), F.col("max_hi")).cast("double").alias("fwd_packet_len_max"),
        split(F.coalesce("before_max", zero), F.col("max_hi"), F.col("max_lo")).cast("double").alias("bwd_packet_len_max"),
        iat_mean.alias("flow_iat_mean"),
        F.sqrt(F.greatest(iat_var, zero)).alias("flow_iat_std"),
        F.coalesce(F.col("iat_max") / float(SECOND), zero).alias("flow_iat_max"),
        F.coalesce(F.col("iat_min") / float(SECOND), zero).alias("flow_iat_min"),
        *[F.col(f).alias(f"{f}_flag_count") for f in FLAGS],
        split(n - before_n, F.col("n_lo"), n - F.col("n_lo")).alias("fwd_packet_count"),
        split(before_n, n - F.col("n_lo"), F.col("n_lo")).alias("bwd_packet_count"),
        src_ip.alias("_src_ip"), dst_ip.alias("_dst_ip"),
        pick(src_lo, F.col("lo_port"), F.col("hi_port")).alias("_src_port"),
        dst_port.alias("_dst_port"),
        F.col("protocol"),
        stamp("first_us").alias("_timestamp"),
        stamp("last_us").alias("flow_end"),
    )
    return with_direction(out, home_nets).select(*[f.name for f in FLOW_SCHEMA])


def aggregate_flows(
    packets: DataFrame,
    gap_seconds: float = 60.0,
    home_nets: Iterable[str] = (),
    slice_seconds: float | None = None,
    combine_ties: bool = True,
    orient: str = "first_syn",
) -> DataFrame:
    """Flows of at least two packets with the 20 model features, endpoints, times and direction.

    ``packet_id`` must be unique and below 2**61; it breaks ties between equal timestamps and, as
    the id of the first packet, names the flow. ``combine_ties=False`` saves the first shuffle and
    is right for clocks so fine that one key hardly ever repeats a microsecond.
    """
    gap_us = to_micros(gap_seconds)
    slice_us = to_micros(min(gap_seconds, slice_seconds or MAX_SLICE_SECONDS))
    if slice_us <= 0:
        raise ValueError("gap and slice must be positive")
    measures = _measures(packets)
    if combine_ties:
        ticks = _ticks(measures, slice_us)
    else:
        ticks = measures.withColumn("slice", slice_of(F.col("us"), slice_us))
    ntz = packets.schema["ts"].dataType.typeName() == "timestamp_ntz"
    return _features(_sessions(_slices(ticks), gap_us, orient), home_nets, ntz, orient)


def merge_sensors(*sources: DataFrame) -> DataFrame:
    """Packets of several sensors together; a packet two sensors saw counts twice."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
