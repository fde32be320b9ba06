"""Labels for a stream of flows from a stream of alerts, without a row for each pair.

Time is cut into cells as long as the band. A flow enters its own cell, an alert its own and both neighbours, so
all that can meet is in one cell of one key. Cells of keys are dealt into a fixed number of buckets, so that state
is read and written once for many of them; a busy key is in all buckets, as its cells are. What comes is folded batch
by batch: alerts of one cell, time and label are one entry with a count, and rows wait in pieces of bounded size under the
time when their first one leaves. When the watermark has passed a cell and its band, the cell's flows leave with
their labels and counts, found by two binary searches in running sums, and its rows are gone.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.functions.times import micros, slice_of, to_micros
from netloom.operators.labels import KEYS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Flows wait as text; times keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CHUNK = 4096  # rows of one piece
BUCKETS = 256  # groups of cells; a checkpoint goes on with the number that it began with


def _packed(rows) -> tuple[bytes]:
    import pyarrow as pa

    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value):
    import pyarrow as pa

    return pa.ipc.open_stream(bytes(value[0])).read_pandas()


class Alerts:
    """Entries (pair, cell, us, label, n) that flows of the same pair and cell look their counts up in."""

    def __init__(self, entries, band_us: int):
        import numpy as np

        self.band, self.width = band_us, 4 * band_us
        keys = ["pair", "cell", "label"]
        kind = entries.groupby(keys, sort=False).ngroup().to_numpy()
        self.kinds = entries[keys].assign(kind=kind).drop_duplicates("kind")
        # Kinds lie one behind the other; times of a cell and its neighbours are at most three bands apart.
        spot = self._spot(kind, entries)
        order = np.argsort(spot, kind="stable")
        self.spot, self.total = spot[order], np.concatenate([[0], np.cumsum(entries["n"].to_numpy()[order])])

    def _spot(self, kind, rows):
        return kind * self.width + (rows["us"] - rows["cell"]).to_numpy() + self.band

    def labelled(self, flows):
        """(body, label, times): each flow once for each label of the alerts less than the band away, or as BENIGN."""
        import numpy as np
        import pandas as pd

        flows = flows.assign(row=np.arange(len(flows)))
        met = flows[["pair", "cell", "us", "row"]].merge(self.kinds, on=["pair", "cell"])
        spot = self._spot(met["kind"].to_numpy(), met)
        times = self.total[np.searchsorted(self.spot, spot + self.band, side="left")] - self.total[np.searchsorted(self.spot, spot - self.band, side="right")]
        some = times > 0
        row, body = met["row"].to_numpy()[some], flows["body"].to_numpy()
        alone = np.setdiff1d(flows["row"].to_numpy(), row)
        return pd.DataFrame({
            "body": np.concatenate([body[row], body[alone]]), "label": [x or "BENIGN" for x in met["label"][some]] + ["BENIGN"] * len(alone),
            "times": np.concatenate([times[some], np.ones(len(alone))]).astype("int64")})


class LabelProcessor(StatefulProcessor):
    def __init__(self, band_us: int):
        self.band_us = band_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flows = handle.getMapState("flows", "leaves bigint, piece bigint", "rows binary")
        self.alerts = handle.getMapState("alerts", "leaves bigint, piece bigint", "rows binary")
        self.held = handle.getValueState("held", "pieces bigint, timer bigint")

    def _put(self, state, rows, pieces: int) -> int:
        """Keeps rows in pieces, each under the time when its first row leaves; the number of pieces so far."""
        rows = rows.sort_values("leaves", kind="stable")
        for at in range(0, len(rows), CHUNK):
            piece = rows.iloc[at : at + CHUNK]
            state.updateValue((int(piece["leaves"].iloc[0]), pieces), _packed(piece))
            pieces += 1
        return pieces

    def _merged(self, alerts):
        return alerts.groupby(["pair", "cell", "us", "label", "leaves"], sort=False, as_index=False)["n"].sum()

    def handleInputRows(self, key, rows, timerValues):
        pieces, timer = self.held.get() or (0, None)
        first = timer
        for batch in rows:
            # The last alert that can matter is nearly two cells after the start of this one.
            batch = batch.assign(leaves=(batch["cell"] + 2 * self.band_us) // 1000 + 1)
            first = min(int(batch["leaves"].min()), first or sys.maxsize)
            mark = batch["body"].isna()
            if mark.any():
                alerts = batch.loc[mark, ["pair", "cell", "us", "label", "leaves"]]
                pieces = self._put(self.alerts, self._merged(alerts.assign(label=alerts["label"].fillna(""), n=1)), pieces)
            if not mark.all():
                pieces = self._put(self.flows, batch.loc[~mark, ["pair", "cell", "us", "body", "leaves"]], pieces)
        if first != timer:
            self.handle.registerTimer(first)
        self.held.update((pieces, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now, held = timerValues.getCurrentWatermarkInMs(), self.held.get()
        if held is None:  # an earlier timer of this batch has let everything go
            return
        pieces = held[0]

        def due(state):
            """Pieces of which something leaves, one by one, as what leaves and what stays."""
            for entry in [tuple(k) for k in state.keys() if k[0] <= now]:
                rows = _unpacked(state.getValue(entry))
                state.removeKey(entry)
                yield rows[rows["leaves"] <= now], rows[rows["leaves"] > now]

        gone, stays = zip(*due(self.alerts)) if any(k[0] <= now for k in self.alerts.keys()) else ((), ())
        if sum(map(len, stays)):
            pieces = self._put(self.alerts, self._merged(pd.concat(stays)), pieces)
        alerts = Alerts(self._merged(pd.concat(gone)), self.band_us) if gone else None
        waiting = []
        for flows, later in due(self.flows):
            if len(flows):
                yield alerts.labelled(flows) if alerts else pd.DataFrame({"body": flows["body"], "label": "BENIGN", "times": 1})
            waiting.append(later)
            if sum(map(len, waiting)) >= CHUNK:
                pieces = self._put(self.flows, pd.concat(waiting), pieces)
                waiting.clear()
        if sum(map(len, waiting)):
            pieces = self._put(self.flows, pd.concat(waiting), pieces)
        left = [k[0] for state in (self.flows, self.alerts) for k in state.keys()]
        if left:
            self.handle.registerTimer(min(left))
            self.held.update((pieces, min(left)))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def stream_label_counts(flows: DataFrame, alerts: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Flows of a stream once for each label of the alerts less than ``seconds`` away, with their number ``times``.

    Both streams need a watermark (on ``flow_end`` and ``alert_ts``). A flow without such alerts leaves once as BENIGN;
    every flow leaves when the slower watermark has passed all alerts that it could meet, one without a whole key at once.
    """
    band = to_micros(seconds)
    flows = flows.drop("label", "times")
    whole = " AND ".join(f"{c} IS NOT NULL" for c in KEYS)
    alone = flows.where(f"NOT ({whole})").select("*", F.lit("BENIGN").alias("label"), F.lit(1).cast("long").alias("times"))
    f_us, a_us = micros(flows, "flow_end"), micros(alerts, "alert_ts")
    body = F.to_json(F.struct(*flows.columns), _JSON)
    stamp = F.col("flow_end").cast("timestamp").alias("ts")
    entered = flows.where(whole).select(*KEYS, slice_of(f_us, band).alias("cell"), body.alias("body"), f_us.alias("us"), F.lit(None).cast("string").alias("label"), stamp)
    own = slice_of(a_us, band)
    cells = F.explode(F.array(own - band, own, own + band)).alias("cell")
    marks = alerts.where(whole).select(*KEYS, cells, F.lit(None).cast("string").alias("body"), a_us.alias("us"), "label", F.col("alert_ts").cast("timestamp").alias("ts"))
    both = entered.unionByName(marks)
    bucket = F.pmod(F.xxhash64(*KEYS, "cell"), F.lit(BUCKETS)).cast("int").alias("bucket")
    dealt = both.select(bucket, F.to_json(F.struct(*KEYS)).alias("pair"), "cell", "us", "body", "label", "ts")
    found = dealt.groupBy("bucket").transformWithStateInPandas(
        LabelProcessor(band), "body string, label string, times bigint", "Append", "EventTime")
    back = F.from_json("body", flows.schema, _JSON)
    return found.select(back.alias("flow"), "label", "times").select("flow.*", "label", "times").unionByName(alone)
