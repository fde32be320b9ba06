import datetime as dt
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import simulate
from pyspark.sql import functions as F
from test_data import _brute_labels
from test_flows import random_packets, tcp

from netloom.operators.flows import aggregate_flows
from netloom.plans.detect import DetectConfig
from netloom.schemas import PACKET_SCHEMA
from netloom.sources.packets import stream_packets
from netloom.streaming import runner
from netloom.streaming.dedup_state import stream_dedup
from netloom.streaming.flow_state import stream_flows
from netloom.streaming.label_state import BUCKETS, stream_label_counts
from netloom.streaming.operators import stream_labels

T0 = dt.datetime(2024, 1, 1)


def write_in_files(df, path, n, order):
    """n files, each a later stretch of time, written one after the other."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    step = (hi - lo) / n
    for i in range(n):
        part = df.where((F.col(order) >= F.lit(lo + i * step)) & (F.col(order) < F.lit(lo + (i + 1) * step if i < n - 1 else hi + dt.timedelta(days=1))))
        part.coalesce(1).write.mode("append").parquet(path)


def test_stream_flows_equal_batch(spark, make_packets, tmp_path):
    rows = random_packets(7, 500, keys=5, span=300)
    rows = [dict(p, src_ip="127.0.0.1", dst_ip="127.0.0.1") if i % 3 == 0 else p for i, p in enumerate(rows)]
    end = [dict(tcp(5000, "1.1.1.1", 1, "2.2.2.2", 2), packet_id=9000, protocol=6)]
    df = make_packets(rows + end)
    path = str(tmp_path / "in")
    write_in_files(df.where("packet_id < 9000"), path, 3, "ts")
    df.where("packet_id = 9000").coalesce(1).write.mode("append").parquet(path)
    stream = stream_packets(spark, path, delay="1 seconds", files_per_trigger=1)
    got = runner.drain(stream_flows(stream, 7.0), "t-flows").collect()
    simulate.same_flows(got, simulate.flows(rows, 7.0))


def test_late_packets_do_not_join_across_a_gap(spark, make_packets, tmp_path):
    """A packet before the open flow by more than the gap is a flow of its own, until later ones fill the gap."""
    path = str(tmp_path / "in")
    one = lambda t, i: dict(tcp(t, "10.0.0.1", 5, "9.9.9.9", 80), packet_id=i, protocol=6)
    two = lambda t, i: dict(tcp(t, "10.0.0.2", 5, "9.9.9.9", 80, 100 + i), packet_id=i, protocol=6)
    files = [[one(100, 1), one(105, 2), two(100, 11), two(101, 12)], [one(40, 3), two(70, 13)], [two(85, 14)], [dict(one(5000, 99), src_ip="1.1.1.1")]]
    for rows in files:
        make_packets(rows).coalesce(1).write.mode("append").parquet(path)
    stream = stream_packets(spark, path, delay="200 seconds", files_per_trigger=1)
    got = {r["flow_id"]: r for r in runner.drain(stream_flows(stream, 20.0), "t-late").collect()}
    assert {i: (r["packet_count"], r["duration"]) for i, r in got.items()} == {1: (2, 5.0), 13: (4, 31.0)}
    want = simulate.flows([p for rows in files[:3] for p in rows], 20.0)
    assert {i: r["packet_count"] for i, r in got.items()} == {i: r["packet_count"] for i, r in want.items()}
    assert all(got[i]["src_bytes"] == r["src_bytes"] for i, r in want.items())


def test_detection_stream(spark, make_packets, tmp_path):
    """Two queries end to end: flows and raw alerts, then suppressed alerts and live incidents; a restart goes on."""
    root, src = str(tmp_path / "store"), str(tmp_path / "in")
    rows, n = [], 0
    for k in range(6):
        for j in range(3):
            rows.append(dict(tcp(k * 70 + j, "10.0.0.88", 6000 + k, "8.8.4.4", 4444, syn=int(j == 0)), packet_id=n))
            n += 1
    tail = [dict(tcp(1000 + i * 1000, "1.1.1.1", 1, "2.2.2.2", 2), packet_id=900 + i) for i in range(2)]
    cfg = DetectConfig(dedup_seconds=100)
    runner.use_rocksdb(spark)

    def go():
        p = stream_packets(spark, src, delay="1 seconds", files_per_trigger=1)
        runner.start_flow_sink(stream_flows(p, cfg.gap_seconds), root, str(tmp_path / "c1"), cfg).awaitTermination()
        raw = spark.readStream.schema(spark.read.parquet(f"{root}/raw_alerts").schema).parquet(f"{root}/raw_alerts").withWatermark("alert_ts", "1 seconds")
        cols = ["alert_id", "alert_ts", "_src_ip", "_dst_ip", "_dst_port", "label", "severity"]
        fired = stream_dedup(raw.select(*cols), cfg.dedup_seconds)
        topics = runner.Topics()
        seen = []
        topics.subscribe("alert", lambda rows: 1 / 0)
        topics.subscribe("alert", lambda rows: seen.append(rows.count()))
        runner.start_alert_sink(fired, root, str(tmp_path / "c2"), cfg, topics=topics).awaitTermination()
        return seen

    half = make_packets(rows + tail)
    half.where("packet_id < 9").coalesce(1).write.mode("append").parquet(src)
    go()
    half.where("packet_id between 9 and 899").coalesce(1).write.mode("append").parquet(src)
    half.where("packet_id >= 900").coalesce(1).write.mode("append").parquet(src)
    assert sum(go()) > 0
    assert spark.read.parquet(f"{root}/flows").count() == 6
    fired = sorted((r["alert_id"], r["suppressed_since_last"]) for r in spark.read.parquet(f"{root}/alerts").collect())
    assert fired == [(0, 0), (6, 1), (12, 1)]
    inc = runner.live_incidents(spark, root, T0 + dt.timedelta(seconds=400), 180).collect()
    assert [(r["src_ip"], r["alert_count"], r["status"], r["max_severity"]) for r in inc] == [("10.0.0.88", 3, "active", "high")]


def test_stream_labels_equal_all_pairs(spark, tmp_path):
    """Flows and alerts in five files each, out of order within the watermark's delay; a cell's alerts may come after its flows."""
    runner.use_rocksdb(spark)
    rng = random.Random(12)
    flows = [(i, rng.choice(["a", "b", None]), "x", rng.choice([80, None]), rng.randint(0, 199)) for i in range(150)]
    alerts = [(rng.choice(["a", "b"]), "x", 80, rng.randint(0, 199), rng.choice(["SCAN", "FLOOD", "", None])) for _ in range(100)]
    at = lambda s: T0 + dt.timedelta(seconds=s, microseconds=7)
    f_schema = "flow_id long, _src_ip string, _dst_ip string, _dst_port int, flow_end timestamp, weight double"
    a_schema = "_src_ip string, _dst_ip string, _dst_port int, alert_ts timestamp, label string"
    for k in range(6):
        low, high = (k * 40, k * 40 + 40) if k < 5 else (10**6, 10**6 + 1)
        f = [(i, s, d, p, at(t), i / 3) for i, s, d, p, t in flows if low <= t < high] or [(-1, "z", "z", 1, at(low), 0.0)]
        a = [(s, d, p, at(t), x) for s, d, p, t, x in alerts if low <= t < high] or [("z", "z", 1, at(low), "z")]
        spark.createDataFrame(f, f_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        spark.createDataFrame(a, a_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    read = lambda name, schema, ts: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)).withWatermark(ts, "90 seconds")
    got = runner.drain(stream_label_counts(read("f", f_schema, "flow_end"), read("a", a_schema, "alert_ts"), 5.0), "t-labels").collect()
    counts, _ = _brute_labels(flows, alerts, 5)
    found = {}
    for r in got:
        if r["flow_id"] >= 0:
            assert r["weight"] == r["flow_id"] / 3 and r["flow_end"].microsecond == 7
            found[r["flow_id"], r["label"]] = found.get((r["flow_id"], r["label"]), 0) + r["times"]
    assert found == counts


def test_stream_labels_compare_only_near_alerts(spark, tmp_path):
    """One key; gaps around the band and around the borders of cells, repeated alerts, missing keys and times. A flow looks up the alerts of its time alone."""
    rng = random.Random(3)
    at = lambda us: None if us is None else T0 + dt.timedelta(microseconds=us)
    flows = [(i, "a", "x", 80, 2_500_000 * rng.randint(0, 40) + rng.randint(-1, 1)) for i in range(120)] + [(120, None, "x", 80, 0), (121, "a", "x", 80, None)]
    alerts = [("a", "x", 80, 2_500_000 * rng.randint(0, 60) + rng.randint(-1, 1), rng.choice(["SCAN", None])) for _ in range(40)] * 2 + [("a", "x", 80, None, "NEVER"), (None, "x", 80, 0, "NEVER")]
    last = 10**9
    spark.createDataFrame([(*f[:4], at(f[4])) for f in [*flows, (-1, "z", "z", 1, last)]], "flow_id long, _src_ip string, _dst_ip string, _dst_port int, flow_end timestamp").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([(*a[:3], at(a[3]), a[4]) for a in [*alerts, ("y", "z", 1, last, "z")]], "_src_ip string, _dst_ip string, _dst_port int, alert_ts timestamp, label string").write.parquet(str(tmp_path / "a"))
    read = lambda name, ts: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name)).withWatermark(ts, "0 seconds")
    joined = stream_labels(read("f", "flow_end"), read("a", "alert_ts"))
    got = sorted((r["flow_id"], r["label"]) for r in runner.drain(joined, "t-near-labels").collect())
    want = []
    for i, s, _, _, us in flows:
        if us is not None:
            met = [x or "BENIGN" for a, _, _, u, x in alerts if s and a == s and u is not None and abs(us - u) < 5_000_000]
            want += [(i, x) for x in met or ["BENIGN"]]
    assert got == sorted(want) and 200 < len(got)
    plan = spark._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    keys = re.search(r"StreamingSymmetricHashJoin \[(.*?)\], \[(.*?)\], LeftOuter", plan)
    assert "flow_end" in keys[1] and "a_cell" in keys[2]


def test_labels_of_many_cells_are_kept_together(spark, tmp_path):
    """4000 flows in as many cells of two keys take a few pieces of state; those leave whose time the watermark has just reached."""
    runner.use_rocksdb(spark)
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    last = 5000 * 4000 + 1
    flows = [(i, "ab"[i % 2], "x", 80, at(5000 * i)) for i in range(4000)] + [(-1, "z", "z", 1, at(last))]
    alerts = [("a", "x", 80, at(5000 * i + 4999), "SCAN") for i in range(0, 4000, 4)] + [("z", "z", 1, at(last), "z")]
    spark.createDataFrame(flows, "flow_id long, _src_ip string, _dst_ip string, _dst_port int, flow_end timestamp").coalesce(1).write.parquet(str(tmp_path / "f"))
    spark.createDataFrame(alerts, "_src_ip string, _dst_ip string, _dst_port int, alert_ts timestamp, label string").coalesce(1).write.parquet(str(tmp_path / "a"))
    read = lambda name, ts: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name)).withWatermark(ts, "0 seconds")
    found = stream_label_counts(read("f", "flow_end"), read("a", "alert_ts"), 5.0)
    query = runner.to_parquet(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) < 6 * BUCKETS
    got = {r["flow_id"]: (r["label"], r["times"]) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {i: ("SCAN" if i % 4 == 0 else "BENIGN", 1) for i in range(3999)}


class _Handle:
    """State of one key in memory."""

    def __init__(self):
        self.kept, self.timers = None, set()

    def getListState(self, *_):
        return self

    getValueState = getListState

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def put(self, rows):
        self.kept = rows

    update = put

    def clear(self):
        self.kept = None

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_one_key_with_a_million_alerts():
    """The rows of one fingerprint come in 250 chunks; what is held is far less than the rows as they come."""
    import pandas as pd

    from netloom.streaming.dedup_state import DedupProcessor

    n, chunk = 1_000_000, 4000
    columns = ["alert_id", "alert_ts", "_src_ip", "message"]
    handle, processor = _Handle(), DedupProcessor(60_000_000, columns, None)
    processor.init(handle)
    order = np.random.default_rng(1).permutation(n)
    text = "a rule message that every alert of this fingerprint repeats in full, word for word"

    def rows():
        for at in range(0, n, chunk):
            i = order[at : at + chunk]
            yield pd.DataFrame({"a": i, "b": pd.to_datetime(i * 1000, unit="us"), "c": ["10.0.0.1"] * chunk, "d": [text] * chunk, "e": ["f"] * chunk, "f": i * 1000})

    tracemalloc.start()
    before = pa.total_allocated_bytes()
    fired, most = [], 0
    for part in processor.handleInputRows(("f",), rows(), None):
        fired.append(part)
        most = max(most, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1] + most
    tracemalloc.stop()
    fired = pd.concat(fired).sort_values("alert_id")
    assert fired["alert_id"].tolist() == list(range(0, n, 60_000)) and set(fired["message"]) == {text}
    assert fired["suppressed_since_last"].tolist() == [0] + [59_999] * (len(fired) - 1)
    assert handle.kept == (960_000_000, n - 960_001)
    assert peak < 100 * n  # the rows themselves are several times that


def test_busy_key_over_several_batches(spark, make_packets, tmp_path):
    """Packets of a busy key reach the state as one row for each slice, over six batches, and give the sequential model's flows."""
    rng = random.Random(13)
    rows = [dict(tcp(t / 1000, "10.0.0.1" if rng.random() < 0.5 else "9.9.9.9", 5, "9.9.9.9" if rng.random() < 0.5 else "10.0.0.1", 5, rng.randint(40, 1500)), packet_id=i, protocol=6)
            for i, t in enumerate(sorted(rng.randrange(240_000) for _ in range(3000)))]
    path = str(tmp_path / "in")
    write_in_files(make_packets(rows), path, 6, "ts")
    make_packets([dict(tcp(5000, "1.1.1.1", 1, "2.2.2.2", 2), packet_id=9000, protocol=6)]).coalesce(1).write.mode("append").parquet(path)
    stream = stream_packets(spark, path, delay="1 seconds", files_per_trigger=1)
    got = runner.drain(stream_flows(stream, 7.0), "t-busy").collect()
    simulate.same_flows(got, simulate.flows(rows, 7.0))


def test_many_slices_fold_at_once_and_a_key_has_one_timer():
    """One call folds the packets of several keys and slices; the open flows of a key wait for one timer, which ends all that are over."""
    from netloom.streaming import flow_state as fs

    rng = np.random.default_rng(3)
    n = 500
    us = rng.integers(0, 40_000_000_000, n)
    cols = {"lo_ip": rng.choice(["a", "b"], n), "hi_ip": np.full(n, "z"), "us": us, "slice": us // 1_000_000_000, "code": np.arange(n) * 4 + rng.integers(0, 4, n),
            "n": np.ones(n, dtype=np.int64), "len_all": rng.integers(40, 1500, n), "max_lo": rng.integers(0, 1500, n)}
    cols |= {c: np.full(n, 6, dtype=np.int32) for c in ("lo_port", "hi_port", "protocol")}
    cols |= {c: cols["len_all"] for c in [*fs._ADDED, "max_hi"] if c not in cols}
    got = {(r["lo_ip"], r["first_us"] // 1_000_000_000): r for r in fs._fold_slices(pa.table(cols)).to_pylist()}
    for (ip, cell), r in got.items():
        at = sorted(np.flatnonzero((cols["lo_ip"] == ip) & (cols["slice"] == cell)), key=lambda i: us[i])
        opens = [i for i in at if cols["code"][i] & 1]
        turn = at.index(opens[0]) if opens else 0
        waits = [int(us[b] - us[a]) for a, b in zip(at, at[1:])]
        skipped = waits.pop(turn - 1) if turn else None
        known = lambda v: None if v == fs._UNKNOWN else v
        assert (r["n"], r["len_all"], r["last_us"], r["flow_code"]) == (len(at), cols["len_all"][at].sum(), us[at[-1]], cols["code"][at[0]])
        assert (known(r["iat_max"]), known(r["iat_min"]), known(r["skipped_us"])) == (max(waits, default=None), min(waits, default=None), skipped)
        assert (known(r["before_n"]), known(r["after_max"])) == ((turn, max(cols["max_lo"][at[turn:]])) if turn else (None, None))
    assert sum(r["n"] for r in got.values()) == n

    handle, processor = _Handle(), fs.FlowProcessor(1_000_000)
    processor.init(handle)
    row = {**dict.fromkeys([*fs._TOTALS, "iat_sq"], 0), "turn_code": fs._UNKNOWN}
    rows = [(*"a1z16", *({**row, "first_us": t, "last_us": t}[c] for c in [*fs._TOTALS, "iat_sq"])) for t in (0, 10_000_000, 20_000_000)]
    list(processor.handleInputRows(tuple("a1z16"), iter(rows), None))
    assert handle.timers == {1001}
    handle.timers.clear()

    class Now:
        def getCurrentWatermarkInMs(self):
            return 12_000

    assert [r["last_us"] for r in processor.handleExpiredTimer(tuple("a1z16"), Now(), None)] == [0, 10_000_000]
    assert handle.timers == {21_001} and len(handle.kept) == 1


def test_topics():
    t = runner.Topics()
    with pytest.raises(ValueError):
        t.subscribe("nope", print)
    t.publish("nope", None)


def test_live_incidents_in_any_order(spark, tmp_path):
    """Earlier alerts extend an incident, bridging ones merge two; versions that are taken over do not count."""
    root = str(tmp_path / "live")
    batches = [[(1, 100, "a")], [(2, 90, "a"), (3, 1000, "b")], [(4, 110, "a")], [(5, 400, "a")], [(6, 255, "a")], [(7, 5000, "b"), (8, 400, "a")]]
    for number, rows in enumerate(batches):
        data = [(i, T0 + dt.timedelta(seconds=t), s, "high" if i == 4 else "low") for i, t, s in rows]
        batch = spark.createDataFrame(data, "alert_id long, alert_ts timestamp, _src_ip string, severity string")
        named = runner.with_incident(batch, runner.upsert_incidents(spark, batch, root, number, 180, 86400)).collect()
        assert all(r["incident_id"] is not None for r in named) and len(named) == len(rows)
    found = runner.live_incidents(spark, root, T0 + dt.timedelta(seconds=600), 180).collect()
    seconds = lambda t: (t - T0).total_seconds()
    assert sorted((r["src_ip"], seconds(r["start_time"]), seconds(r["end_time"]), r["alert_count"], r["max_severity"]) for r in found) == [
        ("a", 90, 400, 6, "high"), ("b", 1000, 1000, 1, "low"), ("b", 5000, 5000, 1, "low")]
    assert len({r["incident_id"] for r in found}) == 3
    assert spark.read.parquet(f"{root}/incidents_open/batch=5").count() == 3
    # Compacted in between or not, the same incidents are there.
    assert runner.compact_incidents(spark, root) == 5
    again = runner.live_incidents(spark, root, T0 + dt.timedelta(seconds=600), 180).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    updates = [(n, r["status"], r["closed_by"] is not None) for n in range(6) for r in runner.closed_incidents(spark, root, n).collect()]
    assert {u[1] for u in updates} == {"closed"} and any(u[2] for u in updates)


def test_names_after_long_chains_of_merges(spark):
    """Incident 1 was taken over by 2, 2 by 3 and so on; the last one goes on."""
    rows = [(i, None if i == 40 else i + 1, i % 7) for i in range(1, 41)] + [(100, None, 1), (1, None, -1)]
    names = runner.incident_names(spark.createDataFrame(rows, "incident_id long, closed_by long, batch long"))
    assert {r["incident_id"]: r["live_id"] for r in names.collect()} == {i: 40 for i in range(1, 40)}


def test_statistics_follow_the_batches(spark, tmp_path):
    """State merged over three batches, one of them repeated, equals the whole."""
    from netloom.streaming import live_stats

    root = str(tmp_path / "s")
    rows = [(i, "ATTACK", "high" if i % 3 else "low", f"1.1.1.{i % 4}", "2.2.2.2", i / 3000, T0 + dt.timedelta(seconds=i)) for i in range(3000)]
    schema = "alert_id long, label string, severity string, _src_ip string, _dst_ip string, score double, alert_ts timestamp"
    rng = random.Random(5)
    rng.shuffle(rows)
    flows = spark.createDataFrame([(i, 80 + i % 2, T0 + dt.timedelta(seconds=i)) for i in range(900)], "flow_id long, dst_port int, flow_end timestamp")
    for batch, part in enumerate((rows[:1000], rows[1000:2500], rows[2500:])):
        for _ in range(2 if batch == 1 else 1):
            live_stats.record_alerts(spark.createDataFrame(part, schema), root, batch)
    live_stats.record_flows(flows, root, 0)
    got = {(r["kind"], r["item"]): r["value"] for r in live_stats.snapshot(spark, root).collect()}
    assert got["total", "total_alerts"] == 3000 and got["total", "total_flows"] == 900 and got["total", "attack_rate_pct"] == 333.33
    assert got["severity", "high"] == 2000 and got["src_ip", "1.1.1.2"] == 750 and got["port", "81"] == 450
    assert got["score", "score_count"] == 1000 and got["score", "score_mean"] == round(sum(range(2000, 3000)) / 3e6, 4)
    assert got["rate", "alerts_per_sec"] == round(301 / 300, 3) and got["rate", "flows_per_sec"] == 0
    assert spark.read.parquet(f"{root}/stats_alerts/seconds/batch=2").count() == 301
    empty = str(tmp_path / "e")
    assert {r["value"] for r in live_stats.snapshot(spark, empty).collect()} == {0.0}
