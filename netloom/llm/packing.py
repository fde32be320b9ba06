"""Packing of token pieces into sequences of fixed capacity: linear grouping, then best fit.

Texts become pieces of at most ``capacity`` tokens. How many pieces there are of each length is a table of
at most ``capacity`` rows, whatever the corpus; the plan is made from it on the driver:

1. Large lengths are sorted and cut into groups with equally many pieces; each is rounded up to the
   longest of its group, which leaves a few sizes.
2. The sequences for these sizes are optimised over configurations (how many pieces of each size share a
   sequence) by column generation: a linear programme whose columns come from a knapsack.
3. Actual pieces take the places of the rounded ones, which leaves room.
4. Small pieces, and large ones that the rounded-down programme left over, go in descending length where
   they fit best.

A plan is a list of intervals "pieces number lo to hi of this length: so many in each sequence from this
one on, at this offset". Its size depends on the capacity, not on the corpus. Executors number the pieces of
each length (counts by task, then prefix sums over tasks) and look their place up.

Defined results: NULL text counts as empty text, whose only token is the end token; repeated rows are
packed as often as they come; a text longer than the capacity is cut so that all its pieces but the first
are full; an empty table gives no sequences; other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import bytebpe, common
from netloom.session import stage

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str, ranks: str | None = None, end_id: int = 0, with_ids: bool = False,
               text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """Pieces of every document, numbered by length within the task that cut them (part, rank)."""
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = common.numbered_part(), [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        encoder = bytebpe.encoder(tokenizer, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("content"), strict=True):
                ids = encoder.packed(value.as_py() or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(own), part, seen[b - a], *([np.frombuffer(own, "<i4")] if with_ids else [])))
                    seen[b - a] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)] if rows
                                             else [pa.array([], k) for k in kinds[: len(names)]], names)

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("content")).mapInArrow(cut, schema)


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how many of each size."""
    best, taken = np.zeros(capacity + 1), []
    for size in range(len(sizes)):
        s = int(sizes[size])
        for _ in range(capacity // s if worth[size] > 1e-12 else 0):
            more = best.copy()
            more[s:] = np.maximum(best[s:], best[:-s] + worth[size])
            used = more > best
            if not used.any():
                break
            taken.append((size, s, used))
            best = more
    many, room = np.zeros(len(sizes)), capacity
    for size, s, used in reversed(taken):
        if used[room]:
            many[size] += 1
            room -= s
    return float(best[capacity]), many


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: configurations (one in each column) and how often each is used, a fraction."""
    basis = np.diag(np.floor(capacity / sizes))
    inverse, amount = np.diag(1 / basis.diagonal()), demand / basis.diagonal()
    for _ in range(rounds):
        value, column = _knapsack(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        step = (inverse * column).sum(axis=1)
        up = step > 1e-9
        if not up.any():
            break
        out = np.flatnonzero(up)[np.argmin(amount[up] / step[up])]
        basis[:, out] = column
        # The new column replaces the old one: one elimination step instead of a new inverse.
        row, much = inverse[out] / step[out], amount[out] / step[out]
        inverse -= step[:, None] * row
        amount -= step * much
        inverse[out], amount[out] = row, much
    return basis, np.maximum(amount, 0)


class _Plan:
    """Sequences under way, as runs of consecutive sequences with equal room."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []  # length, lo, hi, first sequence, in each, offset
        self.runs: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
        self.rooms: list[int] = []  # those with runs, ascending

    def add_run(self, room: int, first: int, many: int) -> None:
        if many and room:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((first, many))

    def open(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def best_fit(self, length: int, lo: int, hi: int) -> None:
        while lo < hi:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                many = -(-(hi - lo) // (self.capacity // length))
                self.add_run(self.capacity, self.open(many), many)
                continue
            room = self.rooms[at]
            first, many = self.runs[room].pop()
            if not self.runs[room]:
                del self.runs[room]
                self.rooms.pop(at)
            each = min(room // length, hi - lo)
            filled = min(many, (hi - lo) // each)
            self.intervals.append((length, lo, lo + filled * each, first, each, self.capacity - room))
            lo += filled * each
            self.add_run(room - each * length, first, filled)
            self.add_run(room, first + filled, many - filled)


def _grouped(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """Lengths, longest first, in groups of equally many pieces: (length, lo, hi) by rank within the length."""
    total, out, left = sum(n for _, n in counts), [], 0
    width = max(1, -(-total // groups))
    for length, n in counts:
        lo = 0
        while lo < n:
            if left == 0:
                out.append([])
                left = width
            take = min(left, n - lo)
            out[-1].append((length, lo, lo + take))
            lo, left = lo + take, left - take
    return out


def plan_sequences(counts: dict[int, int], capacity: int, groups: int, small: int) -> _Plan:
    """``counts``: pieces of each length. Lengths above ``small`` are rounded up in ``groups`` groups."""
    plan = _Plan(capacity)
    if full := counts.get(capacity, 0):
        plan.intervals.append((capacity, 0, full, plan.open(full), 1, 0))
    large = [(length, n) for length, n in sorted(counts.items(), reverse=True) if small < length < capacity]
    rest = [(length, 0, n) for length, n in counts.items() if length <= small]
    streams = _grouped(large, groups)
    if streams:
        sizes = np.array([s[0][0] for s in streams])
        columns, amount = configurations(sizes, np.array([sum(hi - lo for _, lo, hi in s) for s in streams], dtype=float), capacity)
        for column, many in zip(columns.T.round().astype(int), np.floor(amount + 1e-6).astype(int), strict=True):
            have = min([int(many), *(sum(hi - lo for _, lo, hi in streams[g]) // column[g] for g in np.flatnonzero(column))])
            if not have:
                continue
            base = plan.open(have)
            segments = [(0, have, 0)]  # first, how many, tokens used
            for g in np.repeat(np.arange(len(streams)), column):
                after = []
                for start, width, used in segments:
                    while width:
                        length, lo, hi = streams[g][0]
                        take = min(width, hi - lo)
                        plan.intervals.append((length, lo, lo + take, base + start, 1, used))
                        after.append((start, take, used + length))
                        start, width = start + take, width - take
                        streams[g][0] = (length, lo + take, hi)
                        if lo + take == hi:
                            streams[g].pop(0)
                segments = after
            for start, width, used in segments:
                plan.add_run(capacity - used, base + start, width)
        rest += [piece for s in streams for piece in s]
    for length, lo, hi in sorted(rest, reverse=True):
        plan.best_fit(length, lo, hi)
    return plan


def best_plan(counts: dict[int, int], capacity: int) -> _Plan:
    """The plan with the fewest sequences over a few grouping widths and borders between large and small."""
    tries = [(64, capacity // 2), (64, capacity // 3), (128, capacity // 2), (128, 2 * capacity // 5)]
    return min((plan_sequences(counts, capacity, *t) for t in tries), key=lambda p: (p.sequences, len(p.intervals)))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces that :func:`cut_pieces` made and a table holds."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_plan(counts, capacity)
    table = np.array(sorted(plan.intervals), dtype=np.int64).reshape(-1, 6)
    heads = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), dtype=np.int64)
            for size in np.unique(length):
                own, lows = length == size, table[heads[size] : heads[size + 1], 1]
                at[own] = heads[size] + np.searchsorted(lows, rank[own], side="right") - 1
            _, lo, _, first, each, offset = table[at].T
            columns = {c: batch.column(c) for c in batch.schema.names if c not in ("rank", "part")}
            columns["sequence_id"] = pa.array(first + (rank - lo) // each)
            columns["offset"] = pa.array(offset + (rank - lo) % each * length)
            yield pa.RecordBatch.from_pydict(columns)

    # Number of the piece among all of its length: those of earlier tasks, and those before it in its task.
    tasks = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    kept = [c for c in pieces.columns if c not in ("rank", "part")]
    schema = ", ".join(f"{c} {dict(pieces.dtypes)[c]}" for c in kept) + ", sequence_id bigint, offset bigint"
    return ranked.select(*kept, "rank").mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                   text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    if ranks and not bytebpe.same_vocabulary(tokenizer, ranks):
        raise ValueError(f"{ranks} has another vocabulary than {tokenizer}")
    common.tune(docs.sparkSession)
    return pack(stage(cut_pieces(docs, capacity, tokenizer, ranks, end_id, with_ids, text, ident), "pieces"), capacity)
