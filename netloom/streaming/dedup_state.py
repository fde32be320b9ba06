"""Alert suppression on a stream: per fingerprint the last firing time and the number held back.

A fingerprint's new rows are taken in chunk by chunk: two numbers for each row, and the other columns packed with
their repeated texts stored once, as the alerts of a busy fingerprint are alike.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.functions.times import micros, to_micros
from netloom.operators.dedup import alert_fingerprint

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class DedupProcessor(StatefulProcessor):
    def __init__(self, window_us: int, columns: list[str], count_windows: int | None):
        self.window_us = window_us
        self.columns = columns
        self.count_windows = count_windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us bigint, held bigint")

    def _expiry(self, last_us: int) -> int:
        return (last_us + 2 * self.window_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pyarrow as pa

        # Chunk by chunk: times and ids as plain numbers, the other columns packed until the firing rows are known.
        times, ids, chunks = [], [], []
        for pdf in rows:
            pdf.columns = [*self.columns, "fp", "us"]  # names with a leading underscore do not survive the transfer
            times.append(pdf["us"].to_numpy(dtype=np.int64))
            ids.append(pdf["alert_id"].to_numpy(dtype=np.int64))
            packed = pa.Table.from_pandas(pdf[self.columns], preserve_index=False)
            chunks.append(pa.table({c: packed[c].dictionary_encode() if pa.types.is_string(packed[c].type) or pa.types.is_large_string(packed[c].type) else packed[c]
                                    for c in self.columns}))
        sizes = [len(t) for t in times]
        us = np.concatenate(times)
        order = np.lexsort((np.concatenate(ids), us))
        us = us[order]
        last, held = self.last.get() if self.last.exists() else (None, 0)
        old = self._expiry(last) if last is not None else None
        at, carried, i = [], [], 0
        while True:  # jump from one firing alert to the next
            nxt = i if last is None else max(i, int(np.searchsorted(us, last + self.window_us, side="left")))
            held += min(nxt, len(us)) - i
            if nxt >= len(us):
                break
            at.append(nxt)
            carried.append(held)
            last, held, i = int(us[nxt]), 0, nxt + 1
        self.last.update((last, held))
        new = self._expiry(last)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        # The firing rows leave chunk by chunk, as they were packed.
        fired, counts = order[at], np.array(carried, dtype=np.int64)
        start = 0
        for size, chunk in zip(sizes, chunks, strict=True):
            mine = np.flatnonzero((fired >= start) & (fired < start + size))
            if len(mine):
                taken = chunk.take(pa.array(fired[mine] - start))
                plain = pa.table({c: taken[c].cast(pa.string()) if pa.types.is_dictionary(taken[c].type) else taken[c] for c in self.columns})
                yield plain.to_pandas().assign(suppressed_since_last=counts[mine])
            start += size

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists():
            last, held = self.last.get()
            counted = None if self.count_windows is None else (last + self.count_windows * self.window_us) // 1000 + 1
            if held == 0 or counted is not None and counted <= now:
                if self._expiry(last) <= now:
                    self.last.clear()
            elif counted is not None:
                self.handle.registerTimer(counted)
        return iter([])

    def close(self) -> None:
        pass


def stream_dedup(alerts: DataFrame, window_seconds: float = 60.0, count_windows: int | None = None) -> DataFrame:
    """Firing alerts of a stream with a watermark on ``alert_ts``.

    A fingerprint without held-back alerts is forgotten two windows after it fired. One with such alerts keeps its two
    numbers until the next alert reports them, as in batch, or for ``count_windows`` windows.
    """
    columns = alerts.columns
    schema = T.StructType([*alerts.schema.fields, T.StructField("suppressed_since_last", T.LongType())])
    keyed = alerts.withColumns({"fp": alert_fingerprint(), "us": micros(alerts, "alert_ts")})
    fired = keyed.groupBy("fp").transformWithStateInPandas(
        DedupProcessor(to_micros(window_seconds), columns, count_windows), schema, "Append", "EventTime", eventTimeColumnName="alert_ts")
    n = F.col("suppressed_since_last")
    note = F.when(n > 0, F.format_string("%d similar alert(s) suppressed in last %ds", n, F.lit(int(window_seconds))))
    return fired.withColumn("suppression_note", note)
