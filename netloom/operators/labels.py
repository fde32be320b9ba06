"""Flows labelled by the alerts raised close to them, without a row for each pair.

Time is cut into cells as long as the band, and the cell is part of the key. Any two times of one cell are
closer than the band, so of the alerts within the band of a flow those in its own cell are all of that cell;
those in the cell before are the latest ones there, and those in the cell after the earliest. Each alert
therefore enters three cells: its own, where it only adds to a total, and as an edge value its two neighbours,
moved by one band so that it falls among their times. There one ordered pass over flows and edge values
carries running totals: what lies beyond a flow on the side of the neighbour is within its band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.times import micros, slice_of, to_micros

KEYS = ["_src_ip", "_dst_ip", "_dst_port"]
_BEFORE, _AFTER = -1, 1  # the cell that an edge value comes from, seen from where it is entered


def _marks(alerts: DataFrame, alert_ts: str, band: int) -> DataFrame:
    """Key, cell, side, place (time as it counts in that cell), alert_label and times (how many such alerts)."""
    own = slice_of(F.col("us"), band)
    marks = alerts.select(*KEYS, micros(alerts, alert_ts).alias("us"), F.col("label").alias("alert_label"))
    marks = marks.where(" AND ".join(f"{c} IS NOT NULL" for c in [*KEYS, "us"])).groupBy(*KEYS, "us", "alert_label").agg(F.count(F.lit(1)).alias("times"))
    entries = [(own, F.lit(0), F.col("us")), (own + band, F.lit(_BEFORE), F.col("us") + band), (own - band, F.lit(_AFTER), F.col("us") - band)]
    cells = F.explode(F.array(*[F.struct(c.alias("cell"), s.alias("side"), p.alias("place")) for c, s, p in entries]))
    return marks.select(*KEYS, "alert_label", "times", cells.alias("at")).select(*KEYS, "at.*", "alert_label", "times")


def _entered(flows: DataFrame, marks: DataFrame, near: DataFrame, flow_ts: str, band: int) -> DataFrame:
    """The flows' different times, where their key has alerts in the cells around them, among the edge values of their cells.

    ``near`` has what a time takes over from its whole cell, a row or more for each cell that holds marks. Flows of one
    key and time meet the same alerts, so only key and time travel; ``met`` marks them.
    """
    times = flows.select(*KEYS, micros(flows, flow_ts).alias("place")).distinct()
    placed = times.withColumn("cell", slice_of(F.col("place"), band)).join(near.withColumn("met", F.lit(True)), [*KEYS, "cell"])
    return placed.unionByName(marks.where("side != 0"), allowMissingColumns=True)


def _labelled(flows: DataFrame, found: DataFrame, flow_ts: str, **otherwise: Column) -> DataFrame:
    """Flows with what was found for their key and time, or else with the values named.

    Flows travel as one struct, so none of their columns can clash with the names used here.
    """
    whole = flows.select(F.struct(*[F.col(f"`{c}`") for c in flows.columns]).alias("flow"), *KEYS, micros(flows, flow_ts).alias("place"))
    joined = whole.join(found.select(*KEYS, "place", *otherwise), [*KEYS, "place"], "left")
    return joined.select("flow.*", *[F.coalesce(c, value).alias(c) for c, value in otherwise.items()])


def _passed(keys: list[str], value) -> list[Column]:
    """``value(side)`` over the edge values within a flow's band: earlier places from the cell after, later ones from the cell before."""
    entry = F.col("met").isNull()  # at equal times a flow comes first: an alert one whole band away is outside
    ahead = Window.partitionBy(*keys).orderBy(F.asc("place"), entry).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc("place"), entry).rowsBetween(Window.unboundedPreceding, 0)
    return [value(_AFTER).over(ahead), value(_BEFORE).over(behind)]


def _shown(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("BENIGN"))


def label_counts(flows: DataFrame, alerts: DataFrame, seconds: float = 5.0, flow_ts: str = "flow_end", alert_ts: str = "alert_ts") -> DataFrame:
    """Each flow once for each label of the alerts less than ``seconds`` away, with ``times``, the number of these alerts.

    A flow without such an alert appears once as BENIGN with ``times`` 1. Source, target and target port must agree;
    a missing one never does. An alert without label counts as BENIGN. Flows are read twice: only the times of those that
    have alerts of their key around them are ordered, and the flows take their labels over in one join.
    """
    band = to_micros(seconds)
    flows = flows.drop("label", "alert_label", "times")
    marks, cell, zero = _marks(alerts, alert_ts, band), [*KEYS, "cell"], F.lit(0).cast("long")
    inside = marks.groupBy(*cell, "alert_label").agg(F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("times"))), zero).alias("inside"))
    rows = _entered(flows, marks, inside, flow_ts, band)

    def entries(side: int) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("times")))

    ahead, behind = _passed([*cell, "alert_label"], entries)
    total = sum((F.coalesce(c, zero) for c in ("ahead", "behind")), F.col("inside"))
    # Alerts in the neighbouring cells may all be too far: such a time is not found, as one without any alert around it.
    found = rows.withColumns({"ahead": ahead, "behind": behind}).where("met").withColumn("times", total).where("times > 0")
    found = found.withColumn("label", _shown(F.col("alert_label")))
    return _labelled(flows, found, flow_ts, label=F.lit("BENIGN"), times=F.lit(1).cast("long"))


def label_flows(flows: DataFrame, alerts: DataFrame, seconds: float = 5.0, flow_ts: str = "flow_end", alert_ts: str = "alert_ts", one_label: bool = False) -> DataFrame:
    """Flows with the label of the alerts less than ``seconds`` away; BENIGN without any.

    A flow appears once for each of these alerts, which :func:`label_counts` says in numbers. ``one_label`` keeps one row
    per flow: any alert label wins over BENIGN, the smallest one when they differ.
    """
    if not one_label:
        copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
        return label_counts(flows, alerts, seconds, flow_ts, alert_ts).withColumn("times", copies).drop("times")
    band = to_micros(seconds)
    flows = flows.drop("label", "alert_label")
    marks = _marks(alerts, alert_ts, band).where("alert_label <> ''")
    near = marks.groupBy(*KEYS, "cell").agg(F.min(F.when(F.col("side") == 0, F.col("alert_label"))).alias("inside"))
    rows = _entered(flows, marks, near, flow_ts, band)
    ahead, behind = _passed([*KEYS, "cell"], lambda side: F.min(F.when(F.col("side") == side, F.col("alert_label"))))
    found = rows.withColumns({"ahead": ahead, "behind": behind}).where("met").withColumn("label", F.least("inside", "ahead", "behind")).where("label IS NOT NULL")
    return _labelled(flows, found, flow_ts, label=F.lit("BENIGN"))
