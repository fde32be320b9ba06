"""Packets -> flows on a stream.

State has two levels, and packets reach neither. A micro-batch's packets of one key and time slice are
sorted and folded into one row of running totals, those of many keys and slices at once; a slice is no longer
than the gap, so no flow breaks inside it. The state of a key sees these rows only, a few for each slice, and joins them in time
order to the flows it holds. A busy key is thus folded by as many tasks as it has slices.

A key may have several open flows: a flow leaves when the watermark lies beyond its gap, as late packets can
reach it until then. Packets that arrive late, before the end of the flow they fall into, add a wait of 0 there
beside the waits among themselves; if they close the gap between two flows, these become one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.functions.times import slice_of, to_micros
from netloom.operators.flows import FLAGS, KEY, _features, _measures, _source_side

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ADDED = ["n", "n_lo", "len_all", "len_lo", "len_sq", *FLAGS]
_TOTALS = [*_ADDED, "max_lo", "max_hi", "first_us", "last_us", "flow_code", "turn_code", "iat_max", "iat_min", "skipped_us",
           "before_n", "before_len", "before_max", "after_max"]
_STATE = ", ".join(f"{c} bigint" for c in _TOTALS) + ", iat_sq double"
_KEY_TYPES = "lo_ip string, lo_port int, hi_ip string, hi_port int, protocol int"
_OUT = f"{_KEY_TYPES}, {_STATE}"
_UNKNOWN = -(1 << 62)  # stands for NULL on the way to the state, where NULLs would turn whole numbers into doubles
SLICE_SECONDS = 60.0
BUCKETS = 1024  # groups that a batch's keys and slices are folded in


def _joined(a: dict, b: dict) -> dict:
    """One flow of two that late packets connect; ``a`` began first."""
    s = dict(a)
    for c in _ADDED:
        s[c] += b[c]
    s["last_us"], wait = max(a["last_us"], b["last_us"]), max(b["first_us"] - a["last_us"], 0)
    s["max_lo"], s["max_hi"] = max(a["max_lo"], b["max_lo"]), max(a["max_hi"], b["max_hi"])
    counted = True
    if a["turn_code"] is not None:
        s["after_max"] = max(a["after_max"], b["max_lo"])
    elif not a["flow_code"] & 1:
        if b["flow_code"] & 1:  # the later flow began with the packet that turns the whole
            s["turn_code"], s["skipped_us"], counted = b["flow_code"], wait, False
            s["before_n"], s["before_len"], s["before_max"], s["after_max"] = a["n"], a["len_all"], a["max_lo"], b["max_lo"]
        elif b["turn_code"] is not None:
            s["turn_code"], s["skipped_us"], s["after_max"] = b["turn_code"], b["skipped_us"], b["after_max"]
            s["before_n"], s["before_len"] = a["n"] + b["before_n"], a["len_all"] + b["before_len"]
            s["before_max"] = max(a["max_lo"], b["before_max"])
    # A wait left out in b, before what was its first opening packet, counts if the whole has turned or opened before.
    settled = a["turn_code"] is not None or a["flow_code"] & 1
    waits = ([wait] if counted else []) + ([b["skipped_us"]] if settled and b["turn_code"] is not None else [])
    s["iat_sq"] += b["iat_sq"] + sum((w / 1e6) ** 2 for w in waits)
    own = [x for x in (a["iat_max"], b["iat_max"], *waits) if x is not None]
    low = [x for x in (a["iat_min"], b["iat_min"], *waits) if x is not None]
    s["iat_max"], s["iat_min"] = max(own, default=None), min(low, default=None)
    return s


def _fold_slices(table):
    """The packets of each key and slice as one row of totals."""
    import numpy as np
    import pyarrow as pa

    sides = [table[c].combine_chunks().dictionary_encode() for c in ("lo_ip", "hi_ip")]
    by = [c.indices.to_numpy() for c in sides] + [table[c].to_numpy() for c in ("lo_port", "hi_port", "protocol", "slice")]
    order = np.lexsort((table["code"].to_numpy(), table["us"].to_numpy(), *by))
    changes = np.zeros(len(order), dtype=bool)
    changes[0] = True
    for c in by:
        changes[1:] |= np.diff(c[order]) != 0
    starts, group = np.flatnonzero(changes), np.cumsum(changes) - 1
    ends = np.append(starts[1:], len(order))
    cols = {c: table[c].to_numpy()[order] for c in ["us", "code", *_ADDED, "max_lo", "max_hi"]}
    us, code, sizes, place = cols["us"], cols["code"], cols["max_lo"], np.arange(len(order))

    waits = np.diff(us, prepend=us[0])
    counted = ~changes
    never = len(order)
    opener = np.minimum.reduceat(np.where(code & 1, place, never), starts)  # the first packet that opens a connection
    turns = (opener < never) & (code[starts] & 1 == 0)
    at = opener[turns]
    counted[at] = False
    early = place < np.where(turns, opener, 0)[group]

    def known(values, where):
        return np.where(where, values, _UNKNOWN)

    def at_turn(values):
        out = np.full(len(starts), _UNKNOWN)
        out[turns] = values
        return out

    totals = {c: np.add.reduceat(cols[c], starts) for c in _ADDED}
    totals |= {c: np.maximum(np.maximum.reduceat(cols[c], starts), 0) for c in ("max_lo", "max_hi")}
    some = np.logical_or.reduceat(counted, starts)
    totals["first_us"], totals["last_us"] = us[starts], us[ends - 1]
    totals["flow_code"], totals["turn_code"], totals["skipped_us"] = code[starts], at_turn(code[at]), at_turn(waits[at])
    totals["iat_max"] = known(np.maximum.reduceat(np.where(counted, waits, 0), starts), some)
    totals["iat_min"] = known(np.minimum.reduceat(np.where(counted, waits, 1 << 62), starts), some)
    for name, c in (("before_n", "n"), ("before_len", "len_all")):
        totals[name] = known(np.add.reduceat(np.where(early, cols[c], 0), starts), turns)
    totals["before_max"] = known(np.maximum.reduceat(np.where(early, sizes, 0), starts), turns)
    totals["after_max"] = known(np.maximum.reduceat(np.where(early, _UNKNOWN, sizes), starts), turns)
    iat_sq = np.add.reduceat(np.where(counted, (waits / 1e6) ** 2, 0.0), starts)
    keys = table.select(KEY).take(pa.array(order[starts]))
    return pa.table([*keys.columns, *(pa.array(totals[c], pa.int64()) for c in _TOTALS), pa.array(iat_sq)], [*KEY, *_TOTALS, "iat_sq"])


class FlowProcessor(StatefulProcessor):
    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def _load(self) -> list[dict]:
        return [dict(zip([*_TOTALS, "iat_sq"], row)) for row in self.open.get()] if self.open.exists() else []

    def _keep(self, flows: list[dict]) -> None:
        if flows:
            self.open.put([tuple(f[c] for c in [*_TOTALS, "iat_sq"]) for f in flows])
        else:
            self.open.clear()

    def _expiry(self, flow: dict) -> int:
        return (flow["last_us"] + self.gap_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        names = [*_TOTALS, "iat_sq"]
        new = [{c: None if v == _UNKNOWN else v for c, v in zip(names, row[len(KEY):])} for row in rows]
        new.sort(key=lambda f: (f["first_us"], f["flow_code"]))
        flows = self._load()
        before = min(map(self._expiry, flows), default=None)
        for part in new:
            first, last = part["first_us"], part["last_us"]
            near = [f for f in flows if first <= f["last_us"] + self.gap_us and last >= f["first_us"] - self.gap_us]
            flows = [f for f in flows if f not in near]
            state, *others = sorted([*near, part], key=lambda f: (f["first_us"], f["flow_code"]))
            for other in others:
                state = _joined(state, other)
            flows.append(state)
        self._keep(flows)
        self._wake(before, flows)
        return iter(())

    def _wake(self, before: int | None, flows: list[dict]) -> None:
        """One timer for a key, when the first of its flows is over."""
        after = min(map(self._expiry, flows), default=None)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        flows = self._load()
        done = [f for f in flows if self._expiry(f) <= now]
        if done:
            left = [f for f in flows if self._expiry(f) > now]
            self._keep(left)
            self._wake(None, left)
            for f in done:
                yield Row(**dict(zip(KEY, key)), **f)

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, gap_seconds: float = 20.0, home_nets: Iterable[str] = (), orient: str = "first_syn") -> DataFrame:
    """Closed flows of a packet stream (``ts`` watermarked), same columns as the batch operator."""
    width = to_micros(min(gap_seconds, SLICE_SECONDS))
    measures = _measures(packets).withColumn("slice", slice_of(F.col("us"), width)).drop("syn_code")
    bucket = F.pmod(F.xxhash64(*KEY, "slice"), F.lit(BUCKETS)).alias("bucket")
    parts = measures.groupBy(bucket).applyInArrow(_fold_slices, _OUT)
    closed = parts.groupBy(*KEY).transformWithState(
        FlowProcessor(to_micros(gap_seconds)), _OUT, "Append", "EventTime")
    return _features(closed.withColumn("src_lo", _source_side(orient)), home_nets, False, orient)
