"""Suppression of repeated alerts inside an anchored window.

An alert fires when no alert with the same fingerprint fired less than ``window`` before it;
suppressed alerts do not move the anchor. That makes every decision depend on the one before it, so
a fingerprint with very many alerts cannot simply be windowed. It is cut into time blocks instead,
each several windows long and handled on its own; a block with too many rows is cut further.

1. alerts with the same fingerprint and microsecond become one tick (map side first);
2. for each block its transition function: where would the firing chain leave the block, for each place it
   could enter? It can only enter in the block's first window, or at the first tick after it. Neighbouring
   entries that leave at the same tick are one row;
3. functions of neighbouring blocks are composed into one, which is associative, so the blocks of a busy
   fingerprint form a tree: groups of bounded size become one block of the next level until what is left of a
   fingerprint is small;
4. that is walked in time order, which tells where the chain really enters each block of the top level, and,
   level by level and group by group, each block below;
5. each block then follows the chain from its real entry and names the alerts that fired.

All steps work on sorted partitions with numpy; a fingerprint's alerts never meet in one group unless
they fall into one block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.times import micros, slice_of, to_micros
from netloom.functions.values import fingerprint
from netloom.session import stage

# Executors get this module's helpers with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_WINDOWS = 64
BLOCK_ROWS = 1 << 16  # ticks of a block; beyond, it is cut between ticks
GROUP_ROWS = 1 << 16  # function rows of a fingerprint that are walked, or composed, in one go
_STEP_SCHEMA = "fp string, block bigint, enter_us bigint, leave_us bigint, after bigint, total bigint"
_STATE_SCHEMA = "fp string, block bigint, last_us bigint, held bigint"
_FIRE_SCHEMA = "alert_id bigint, suppressed bigint"


def alert_fingerprint():
    return fingerprint(F.col("_src_ip"), F.col("_dst_ip"), F.col("_dst_port"), F.col("label"))


def _whole_groups(batches: Iterable, keys: list[str]) -> Iterator:
    """Re-cuts a sorted stream of record batches so that no group of ``keys`` spans two tables."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if part.num_rows == 0:
            continue
        last = part.slice(part.num_rows - 1)
        same = None
        for k in keys:
            eq = pc.equal(part[k], last[k][0])
            same = eq if same is None else pc.and_(same, eq)
        tail = pc.sum(pc.cast(same, pa.int64())).as_py()
        # Sorted input: the rows equal to the last row are the last ``tail`` rows.
        if tail < part.num_rows:
            held.append(part.slice(0, part.num_rows - tail))
            done = pa.concat_tables(held)
            held = [part.slice(part.num_rows - tail)]
            yield done
        else:
            if held and any(held[-1][k][-1] != last[k][0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _layout(table, window_us: int):
    """Group starts, group of each row, offset in block and index of the next tick that could fire."""
    import numpy as np
    import pyarrow.compute as pc

    us = table["us"].to_numpy()
    block = table["block"].to_numpy()
    n = len(us)
    new = np.ones(n, dtype=bool)
    if n > 1:
        fp = table["fp"].combine_chunks()
        changed = pc.not_equal(fp.slice(1), fp.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[1:] = changed | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    ends = np.append(starts[1:], n)
    offset = us - block
    # One rising axis over all groups: a jump of one window never reaches the next group.
    stride = int(offset.max()) + 2 * window_us + 1
    axis = group.astype(np.int64) * stride + offset
    nxt = np.searchsorted(axis, axis + window_us, side="left")
    nxt = np.where(nxt < ends[group], nxt, -1)
    return us, starts, ends, group, offset, nxt


def _block_steps(window_us: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_groups(batches, ["fp", "block"]):
            us, starts, ends, group, offset, nxt = _layout(table, window_us)
            rows = np.arange(len(us))
            leave = np.where(nxt < 0, rows, nxt)
            while True:  # pointer doubling: each round follows twice as many jumps
                further = leave[leave]
                if np.array_equal(further, leave):
                    break
                leave = further
            n = table["n"].to_numpy()
            seen = np.cumsum(n)
            before_group = seen[starts] - n[starts]
            total = (seen[ends - 1] - before_group)[group]
            after = seen[ends - 1][group] - seen[leave] + n[leave] - 1
            head = offset < window_us
            first_late = ~head
            first_late[1:] &= (head[:-1]) | (group[1:] != group[:-1])
            cand = np.flatnonzero(head | first_late)
            # Keep the last of neighbouring candidates that leave at the same tick.
            keep = np.ones(len(cand), dtype=bool)
            keep[:-1] = (leave[cand[1:]] != leave[cand[:-1]]) | (group[cand[1:]] != group[cand[:-1]])
            cand = cand[keep]
            yield from pa.table({
                "fp": table["fp"].take(pa.array(cand)), "block": table["block"].take(pa.array(cand)),
                "enter_us": us[cand], "leave_us": us[leave[cand]], "after": after[cand], "total": total[cand],
            }).combine_chunks().to_batches()
    return run


def _compose(window_us: int):
    """One transition function for each group of neighbouring blocks, from the last block backwards."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_groups(batches, ["fp", "grp"]):
            fp, grp, block = table["fp"].to_pylist(), table["grp"].to_numpy(), table["block"].to_numpy()
            columns = [table[c].to_numpy() for c in ("enter_us", "leave_us", "after", "total")]
            new = np.ones(len(grp), dtype=bool)
            new[1:] = (grp[1:] != grp[:-1]) | np.array([a != b for a, b in zip(fp[1:], fp[:-1])], dtype=bool)
            heads = np.append(np.flatnonzero(new), len(grp))
            out = {c: [] for c in ("fp", "block", "enter_us", "leave_us", "after", "total")}
            for lo, hi in zip(heads[:-1], heads[1:]):
                cuts = lo + np.flatnonzero(np.append(True, block[lo + 1 : hi] != block[lo : hi - 1]))
                enter, leave, after, total = np.array([], np.int64), np.array([], np.int64), np.array([], np.int64), 0
                for x, y in zip(cuts[::-1], np.append(cuts[1:], hi)[::-1]):
                    e, lv, af, tot = (c[x:y] for c in columns)
                    to = np.searchsorted(enter, lv + window_us, side="left")
                    goes = to < len(enter)
                    at = np.minimum(to, max(len(enter) - 1, 0))
                    if len(enter):
                        lv, af = np.where(goes, leave[at], lv), np.where(goes, after[at], af + total)
                    beyond = enter > e[-1]  # the chain may pass this block by
                    enter, leave, after = np.append(e, enter[beyond]), np.append(lv, leave[beyond]), np.append(af, after[beyond])
                    total += int(tot[0])
                head = enter < grp[lo] + window_us
                if not head.all():
                    head[int(head.argmin())] = True  # the first entry after the first window
                enter, leave, after = enter[head], leave[head], after[head]
                keep = np.append(leave[1:] != leave[:-1], True)
                n = int(keep.sum())
                for c, v in (("fp", [fp[lo]] * n), ("block", [int(grp[lo])] * n), ("enter_us", enter[keep].tolist()),
                             ("leave_us", leave[keep].tolist()), ("after", after[keep].tolist()), ("total", [total] * n)):
                    out[c] += v
            yield from pa.table({c: pa.array(v, pa.string() if c == "fp" else pa.int64()) for c, v in out.items()}).to_batches()
    return run


def _walk_blocks(window_us: int):
    """Carries (last fired, alerts held back since) from block to block; constant memory per partition.

    A row without ``enter_us`` sets what is carried into its group.
    """
    def run(batches):
        import pyarrow as pa

        fp_now = block_now = grp_now = None
        last = None
        held = pending = 0
        fired = True
        for batch in batches:
            out = {"fp": [], "block": [], "last_us": [], "held": []}
            cols = [batch.column(c).to_pylist() for c in ("fp", "grp", "block", "enter_us", "leave_us", "after", "total", "last_us", "held")]
            for fp, grp, block, enter, leave, after, total, last_in, held_in in zip(*cols):
                if fp != fp_now or grp != grp_now:
                    fp_now, grp_now, block_now, fired = fp, grp, None, True
                    last, held = last_in, held_in or 0
                if enter is None:
                    continue
                if block != block_now:
                    if not fired:
                        held += pending
                    block_now, fired, pending = block, False, total
                    out["fp"].append(fp)
                    out["block"].append(block)
                    out["last_us"].append(last)
                    out["held"].append(held)
                if not fired and (last is None or enter >= last + window_us):
                    last, held, fired = leave, after, True
            if out["fp"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["fp"], pa.string())] + [pa.array(out[c], pa.int64()) for c in ("block", "last_us", "held")],
                    names=["fp", "block", "last_us", "held"])
    return run


def _block_fires(window_us: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in _whole_groups(batches, ["fp", "block"]):
            us, starts, ends, group, offset, nxt = _layout(table, window_us)
            last = table["last_us"].combine_chunks()
            free = last.is_null().to_numpy(zero_copy_only=False)[starts]
            last = last.fill_null(0).to_numpy()[starts]
            held = table["held"].combine_chunks().fill_null(0).to_numpy()[starts]
            n = table["n"].to_numpy()
            seen = np.cumsum(n)
            base = seen[starts] - n[starts]
            # First tick of each group at or after last + window (the group's first if none fired yet).
            stride = int(offset.max()) + 2 * window_us + 1
            axis = group.astype(np.int64) * stride + offset
            need = np.where(free, 0, np.clip(last + window_us - (us - offset)[starts], 0, stride - 1))
            cur = np.searchsorted(axis, np.arange(len(starts), dtype=np.int64) * stride + need, side="left")
            cur = np.maximum(cur, starts + 1)  # the group's first row is its entry state, not a tick
            live = np.flatnonzero(cur < ends)
            cur = cur[live]
            carried = held[live] + seen[cur] - n[cur] - base[live]
            ids, counts = [], []
            while len(cur):
                ids.append(cur)
                counts.append(carried)
                follow = nxt[cur]
                go = follow >= 0
                prev, cur = cur[go], follow[go]
                carried = seen[cur] - n[cur] - seen[prev] + n[prev] - 1
            if ids:
                at = np.concatenate(ids)
                yield from pa.table({
                    "alert_id": table["alert_id"].take(pa.array(at)),
                    "suppressed": np.concatenate(counts).astype(np.int64),
                }).combine_chunks().to_batches()
    return run


def _blocks(ticks: DataFrame, block_us: int, block_rows: int) -> DataFrame:
    """Ticks with the start of their block. Blocks with too many rows are cut where a fine count says."""
    ticks = stage(ticks.withColumn("cell", slice_of(F.col("us"), block_us)), "ticks")
    heavy = ticks.groupBy("fp", "cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block_rows).select("fp", "cell")
    if heavy.isEmpty():
        return ticks.select("fp", F.col("cell").alias("block"), "us", "alert_id", "n")
    # A tick has a microsecond of its own, so a fine slice of as many microseconds holds no more rows than a block may.
    fine = slice_of(F.col("us"), block_rows)
    counts = ticks.withColumn("fine", fine).join(heavy, ["fp", "cell"], "left_semi").groupBy("fp", "cell", "fine").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("fp", "cell").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("part", F.floor(F.coalesce(F.sum("rows").over(upto), F.lit(0)) / block_rows))
    starts = parts.select("fp", "cell", "fine", F.greatest("cell", F.min("fine").over(Window.partitionBy("fp", "cell", "part"))).alias("start"))
    placed = ticks.withColumn("fine", fine).join(starts, ["fp", "cell", "fine"], "left")
    return stage(placed.select("fp", F.coalesce("start", "cell").alias("block"), "us", "alert_id", "n"), "blocks")


def _walked(rows: DataFrame, window_us: int) -> DataFrame:
    """(fp, block, last_us, held): what the chain carries into each block of rows with fp, grp, and state rows among them."""
    first = F.col("enter_us").isNotNull()  # a group's state comes before its blocks
    return rows.repartition("fp", "grp").sortWithinPartitions("fp", "grp", first, "block", "enter_us").mapInArrow(_walk_blocks(window_us), _STATE_SCHEMA)


def _entry_states(steps: DataFrame, window_us: int, group_rows: int) -> DataFrame:
    """What the chain carries into each block, by a tree of composed functions over busy fingerprints."""
    none = F.lit(None).cast("bigint")
    levels: list[DataFrame] = []  # blocks of busy fingerprints with their group, lowest level first
    done = []
    while True:
        most = steps.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
        if most <= group_rows:
            done.append(steps)
            break
        counts = steps.groupBy("fp", "block").agg(F.count(F.lit(1)).alias("rows"))
        before = Window.partitionBy("fp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        of_fp = Window.partitionBy("fp")
        grouped = counts.select("fp", "block", F.sum("rows").over(of_fp).alias("all"), F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / group_rows).alias("g"))
        grouped = grouped.where(F.col("all") > group_rows).select("fp", "block", F.min("block").over(Window.partitionBy("fp", "g")).alias("grp"))
        size = stage(grouped, "groups")
        # Where each block fills a group there is nothing to compose; the walk then takes them one by one.
        if not size.select(F.count(F.lit(1)) > 1.5 * F.count_distinct("fp", "grp")).first()[0]:
            done.append(steps)
            break
        busy = stage(steps.join(size, ["fp", "block"]), "busy")
        done.append(steps.join(size.select("fp").distinct(), "fp", "left_anti"))
        levels.append(busy)
        composed = busy.repartition("fp", "grp").sortWithinPartitions("fp", "grp", "block", "enter_us").select("fp", "grp", "block", "enter_us", "leave_us", "after", "total")
        steps = stage(composed.mapInArrow(_compose(window_us), _STEP_SCHEMA), "composed")
    whole = [x.withColumn("grp", F.lit(0).cast("bigint")).withColumns({"last_us": none, "held": none}) for x in done]
    state = _walked(reduce(DataFrame.unionByName, whole), window_us)
    for level in reversed(levels):
        state = stage(state, "states")
        groups = level.select("fp", "grp").distinct()
        given = state.join(groups, (state["fp"] == groups["fp"]) & (state["block"] == groups["grp"])).select(
            groups["fp"], groups["grp"], groups["grp"].alias("block"), *[none.alias(c) for c in ("enter_us", "leave_us", "after", "total")], "last_us", "held")
        inner = _walked(level.withColumns({"last_us": none, "held": none}).unionByName(given), window_us)
        passed = state.join(level.select("fp").distinct(), "fp", "left_anti")
        state = passed.unionByName(inner)
    return state


def fired_ids(alerts: DataFrame, window_seconds: float = 60.0, block_windows: int = BLOCK_WINDOWS, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(alert_id, suppressed): the alerts that fire, with how many were held back before each."""
    window_us = to_micros(window_seconds)
    ticks = (
        alerts.select(alert_fingerprint().alias("fp"), micros(alerts, "alert_ts").alias("us"), "alert_id")
        .groupBy("fp", "us").agg(F.min("alert_id").alias("alert_id"), F.count(F.lit(1)).alias("n"))
    )
    ticks = _blocks(ticks, window_us * block_windows, block_rows)
    steps = stage(
        ticks.repartition("fp", "block").sortWithinPartitions("fp", "block", "us")
        .mapInArrow(_block_steps(window_us), _STEP_SCHEMA), "steps")
    state = _entry_states(steps, window_us, group_rows)
    # The entry state of a block travels as the block's first row, which spares a join.
    none = F.lit(None).cast("bigint")
    placed = ticks.select("*", none.alias("last_us"), none.alias("held")).unionByName(
        state.select("fp", "block", F.col("block").alias("us"), none.alias("alert_id"),
                     F.lit(0).cast("bigint").alias("n"), "last_us", "held"))
    return (
        placed.repartition("fp", "block").sortWithinPartitions("fp", "block", "us", "n")
        .mapInArrow(_block_fires(window_us), _FIRE_SCHEMA)
    )


def deduplicate(alerts: DataFrame, window_seconds: float = 60.0, block_windows: int = BLOCK_WINDOWS, **bounds: int) -> DataFrame:
    """The alerts that fire, with ``suppressed_since_last`` and a note for the reader."""
    fires = fired_ids(alerts, window_seconds, block_windows, **bounds)
    n = F.col("suppressed")
    note = F.when(n > 0, F.format_string("%d similar alert(s) suppressed in last %ds", n, F.lit(int(window_seconds))))
    return (
        alerts.join(fires, "alert_id")
        .withColumns({"suppression_note": note, "suppressed_since_last": n})
        .drop("suppressed")
    )
