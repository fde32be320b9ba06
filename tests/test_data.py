import datetime as dt
import json
import random

import numpy as np
import pytest
from compare import most_rows
from pyspark.sql import functions as F

from netloom.operators import analytics, features, labels, ranking, training
from netloom.schemas import ALERT_SCHEMA, FEATURE_COLS
from netloom.sources import feeds, jsonl, packets, tables, training_files

T0 = dt.datetime(2024, 1, 1)


def test_feature_cleaning(spark):
    df = spark.createDataFrame([(float("inf"), float("nan"), 1e12), (1.0, None, float("-inf"))], "flow_bytes_per_sec double, avg_packet_len double, flow_packets_per_sec double")
    out = features.model_features(df)
    assert out.columns == FEATURE_COLS
    r = out.collect()
    assert (r[0]["flow_bytes_per_sec"], r[0]["avg_packet_len"], r[0]["flow_packets_per_sec"], r[0]["rst_flag_count"]) == (0, 0, 1e9, 0)
    assert r[1]["flow_packets_per_sec"] == 0


@pytest.mark.parametrize("size", [1, 2, 5, 3000])
def test_exact_quantiles(spark, size):
    rnd = random.Random(3)
    x = [rnd.choice([1.0, 2.0, rnd.random() * 100]) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in x + [None, float("nan")]], "v double").repartition(6)
    probs = [0.0, 0.01, 0.33, 0.5, 0.95, 0.999, 1.0]
    got = {r["p"]: r["value"] for r in ranking.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.quantile(x, p)) < 1e-9, p


def test_stratified_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("is_attack"))
    s = ranking.stratified_split(df, "is_attack", ["id"])
    assert {(r["is_attack"], r["is_train"]): r["count"] for r in s.groupBy("is_attack", "is_train").count().collect()} == {(0, True): 720, (0, False): 180, (1, True): 80, (1, False): 20}
    assert ranking.shuffled_head(df, 77, ["id"]).count() == 77 and ranking.shuffled_head(df, 5000, ["id"]).count() == 1000


def test_label_band(spark):
    at = lambda s: T0 + dt.timedelta(microseconds=round(s * 1e6))
    f = spark.createDataFrame([(1, "a", "b", 80, at(10)), (2, "a", "b", 80, at(100)), (3, "a", "b", None, at(10))], "flow_id bigint, _src_ip string, _dst_ip string, _dst_port int, flow_end timestamp_ntz")
    a = spark.createDataFrame([("a", "b", 80, at(s), lab) for s, lab in ((5.0, "ATTACK"), (5.000001, "ATTACK"), (5.000001, "ATTACK"), (14.999999, "X"), (15.0, "ATTACK"), (95.0, "ATTACK"))],
                              "_src_ip string, _dst_ip string, _dst_port int, alert_ts timestamp_ntz, label string")
    got = sorted((r["flow_id"], r["label"]) for r in labels.label_flows(f, a).collect())
    assert got == [(1, "ATTACK"), (1, "ATTACK"), (1, "X"), (2, "BENIGN"), (3, "BENIGN")]
    assert sorted((r["flow_id"], r["label"]) for r in labels.label_flows(f, a, one_label=True).collect()) == [(1, "ATTACK"), (2, "BENIGN"), (3, "BENIGN")]


def test_snapshot(spark):
    f = spark.createDataFrame([(i, 80 if i % 2 else 443, T0 + dt.timedelta(seconds=i)) for i in range(10)], "flow_id bigint, dst_port int, flow_end timestamp_ntz")
    a = spark.createDataFrame([(i, "ATTACK", "high" if i else "low", f"1.1.1.{i % 2}", "2.2.2.2", 0.5 + i / 10, T0 + dt.timedelta(seconds=i)) for i in range(5)],
                              "alert_id bigint, label string, severity string, _src_ip string, _dst_ip string, score double, alert_ts timestamp_ntz")
    r = analytics.snapshot(f, a, F.lit("2024-01-01 00:00:09").cast("timestamp_ntz"), 5).first()
    assert (r["total_flows"], r["total_alerts"], r["attack_rate_pct"]) == (10, 5, 50.0)
    assert (r["flows_in_window"], r["alerts_in_window"], r["flows_per_sec"]) == (6, 1, 1.2)
    assert (r["score_mean"], r["score_p90"], r["score_count"]) == (0.7, 0.0, 5)
    assert [tuple(x) for x in r["top_src_ips"]] == [("1.1.1.0", 3), ("1.1.1.1", 2)]
    assert r["severity_counts"] == {"high": 4, "low": 1} and r["protocol_counts"] == {80: 5, 443: 5}


def test_json_log(spark, tmp_path):
    lines = [json.dumps({"_logged_at": 5.0, "_src_ip": "a", "dst_ip": "", "_dst_ip": "b", "dst_port": 0, "_dst_port": 9}), "", "{bad", json.dumps({"_alerted_at": 7, "severity": "high", "score": 0.5}), "[1]", json.dumps({"score": 1})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rec = jsonl.read_log(spark, str(tmp_path / "log.jsonl"))
    out = sorted((r["timestamp"], r["dst_ip"], r["dst_port"], r["severity"]) for r in jsonl.to_alert_table(rec).fillna("-", ["dst_ip"]).fillna(-1, ["dst_port"]).collect())
    assert out == [(0.0, "-", -1, "?"), (5.0, "b", 9, "?"), (7.0, "-", -1, "high")]
    assert [r["_alerted_at"] for r in jsonl.last_records(rec, 1, 1).collect()] == [7.0]


def test_training_files(spark, tmp_path):
    d = tmp_path / "raw"
    (d / "sub").mkdir(parents=True)
    names = list(training.PUBLIC_HEADERS)
    row = ["1"] * (len(names) - 1)
    bad = list(row)
    bad[names.index("Flow Bytes/s")] = "Infinity"
    (d / "a.csv").write_text("\n".join([", ".join(" " + n for n in names), ",".join(row + ["BENIGN "]), ",".join(bad + ["DDoS"]), ",".join(row + ["Web – x"])]), encoding="cp1252")
    (d / "sub" / "b.csv").write_text("\n".join([",".join(FEATURE_COLS + ["label"]), ",".join(["2"] * 20 + ["benign"])]))
    (d / "sub" / "c.csv").write_text("x,y\n1,2\n")
    strict = training_files.load_public_flows(spark, str(d))
    assert sorted((r["is_attack"], r["packet_count"]) for r in strict.collect()) == [(0, 2.0), (1, 2.0)]
    mixed = training_files.load_mixed_flows(spark, str(d))
    assert sorted((r["is_attack"], r["flow_bytes_per_sec"]) for r in mixed.collect()) == [(0, 1.0), (0, 2.0), (1, 0.0), (1, 1.0)]
    assert training_files.load_mixed_flows(spark, str(d), 2).count() == 2


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    a = spark.createDataFrame([(i, T0 + dt.timedelta(hours=20 * i), "high", 0.9) for i in range(6)], "alert_id bigint, alert_ts timestamp_ntz, severity string, score double")
    tables.append_alerts(a.where("alert_id < 3"), root)
    tables.append_alerts(a.where("alert_id >= 3"), root, with_payload=True)
    got = tables.recent_rows(spark, root, "alerts", 4)
    assert [r["alert_id"] for r in got.collect()] == [2, 3, 4, 5] and {f.name for f in ALERT_SCHEMA} <= set(got.columns)
    assert tables.read_table(spark, root, "alerts", "2024-01-04").count() == 2
    tables.clear_table(spark, root, "alerts", ALERT_SCHEMA)
    assert spark.read.schema(ALERT_SCHEMA).parquet(f"{root}/alerts").count() == 0
    tables.export_csv(analytics.alert_table(a.withColumns({c: F.lit("x") for c in ("_src_ip", "_dst_ip", "label", "signature_match")}).withColumns({c: F.lit(1) for c in ("_src_port", "_dst_port")})), f"{root}/csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 6
    for stamp in (1, 2):
        tables.append_history(spark, f"{root}/history", dict(timestamp=stamp, n_samples=3, n_attacks=1, n_benign=2, model_backup="p"))
    assert spark.read.json(f"{root}/history").count() == 2


def test_feeds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\n1.1.1.1\n2.2.2.2 # y\n")
    (tmp_path / "b.txt").write_text("2.2.2.2\n\n3.3.3.3\n")
    bl = feeds.read_blocklist(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert {r["ip"] for r in bl.collect()} == {"1.1.1.1", "2.2.2.2", "3.3.3.3"}
    assert feeds.current_blocklist(spark, f"{tmp_path}/bl").count() == 0
    assert feeds.replace_blocklist(bl, f"{tmp_path}/bl") and not feeds.replace_blocklist(bl.limit(0), f"{tmp_path}/bl")
    assert bl.count() == 3
    assert feeds.current_blocklist(spark, f"{tmp_path}/bl").count() == 3
    assert feeds.replace_blocklist(bl.limit(1), f"{tmp_path}/bl") and feeds.current_blocklist(spark, f"{tmp_path}/bl").count() == 1
    spark.createDataFrame([("9.9.9.9",)], "ip string").write.parquet(f"{tmp_path}/bl/version=999999999-cut")
    (tmp_path / "bl" / "version=999999999-cut" / "_SUCCESS").unlink()  # a version that is not whole
    assert feeds.current_blocklist(spark, f"{tmp_path}/bl").count() == 1


def test_decode_packets(spark, tmp_path):
    rows = [(1, T0, 4, "a", "b", 1, 2, 6, 60, 64, 0x12), (2, T0, 6, "a", "b", 1, 2, 6, 60, 64, 2), (3, T0, 4, "a", "b", 1, 2, 17, 60, 64, 2), (4, T0, 4, "a", "b", 1, 2, 1, 60, 64, 2)]
    spark.createDataFrame(rows, packets.RAW_PACKET_SCHEMA).write.json(str(tmp_path / "p"))
    out = packets.read_packets(spark, str(tmp_path / "p"), "json", packets.RAW_PACKET_SCHEMA).orderBy("packet_id").collect()
    assert [(r["packet_id"], r["src_port"], r["syn"], r["ack"], r["fin"]) for r in out] == [(1, 1, 1, 1, 0), (3, 1, 0, 0, 0), (4, None, 0, 0, 0)]


def test_reports(spark):
    a = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), sev, m, 0.7) for i, (s, sev, m) in enumerate([(1, "high", "A: b"), (95, "low", None), (100000, "medium", "A: c")])],
                              "alert_id bigint, alert_ts timestamp_ntz, severity string, signature_match string, score double").withColumn("_src_ip", F.lit("x"))
    f = a.select(F.col("alert_id").alias("flow_id"), F.col("alert_ts").alias("flow_end"))
    t = analytics.timeline(a.where("alert_id < 2"), 30).orderBy("bin").collect()
    assert [r["n"] for r in t] == [1, 0, 0, 1]
    p = {r["metric"]: (r["cur"], r["prev"], r["delta_pct"]) for r in analytics.compare_periods(f, a, F.lit("2024-01-02 03:46:40").cast("timestamp_ntz")).collect()}
    assert p == {"flows": (1, 2, -50.0), "alerts": (1, 2, -50.0), "high": (1, 1, 0.0)}
    s = {(r["kind"], r["item"]): r["n"] for r in analytics.run_summary(f, a).collect()}
    assert s["rule", "A"] == 2 and s["total", "flows"] == 3 and s["source", "x"] == 3
    assert [r["message"] for r in analytics.alert_ticker(a).collect()] == ["A: c", "Anomaly: 0.700", "A: b"]
    assert analytics.kpis(f, a).first()["attack_rate"] == "100.0%"
    h = analytics.heatmap(a).collect()
    assert [(r["day"], r["h00"], r["h03"]) for r in h] == [("Monday", 2, 0), ("Tuesday", 0, 1)]


def _brute_labels(flows, alerts, band):
    """(flow, label) -> number of alerts, and the single label of each flow, by comparing all pairs."""
    counts, single = {}, {}
    for i, s, d, p, t in flows:
        near = [a[4] or "" for a in alerts if None not in (s, d, p) and a[:3] == (s, d, p) and abs(a[3] - t) < band]
        for label in near or [""]:
            key = i, label or "BENIGN"
            counts[key] = counts.get(key, 0) + 1
        single[i] = min((x for x in near if x), default="BENIGN")
    return counts, single


def test_labels_equal_all_pairs(spark):
    rng = random.Random(11)
    band = 5
    pick = lambda: (rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([80, 80, None]))
    flows = [(i, *pick(), rng.randint(-30, 60)) for i in range(400)]
    alerts = [(*pick(), rng.randint(-30, 60), rng.choice(["SCAN", "FLOOD", "", None])) for _ in range(120)]
    at = lambda s: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)
    f = spark.createDataFrame([(i, s, d, p, at(t), "old", 1) for i, s, d, p, t in flows], "flow_id long, _src_ip string, _dst_ip string, _dst_port int, flow_end timestamp_ntz, label string, place int")
    a = spark.createDataFrame([(s, d, p, at(t), x) for s, d, p, t, x in alerts], "_src_ip string, _dst_ip string, _dst_port int, alert_ts timestamp_ntz, label string")
    counts, single = _brute_labels(flows, alerts, band)
    found = {}
    for r in labels.label_counts(f, a, band).collect():
        assert r["place"] == 1
        found[r["flow_id"], r["label"]] = found.get((r["flow_id"], r["label"]), 0) + r["times"]
    assert found == counts
    copies = {}
    for r in labels.label_flows(f, a, band).collect():
        copies[r["flow_id"], r["label"]] = copies.get((r["flow_id"], r["label"]), 0) + 1
    assert copies == counts
    one = labels.label_flows(f, a, band, one_label=True)
    assert {r["flow_id"]: r["label"] for r in one.collect()} == single and one.count() == len(flows)
    none = labels.label_counts(f, a.limit(0), band)
    assert {(r["label"], r["times"]) for r in none.collect()} == {("BENIGN", 1)} and none.count() == len(flows)


def test_labels_make_no_pairs(spark):
    """One key with 3,000 alerts and 3,000 flows in one band: no step of the plan has more rows than its inputs call for."""
    t = dt.datetime(2024, 1, 1)
    f = spark.createDataFrame([(i, "a", "b", 80, t + dt.timedelta(milliseconds=i)) for i in range(3000)], "flow_id long, _src_ip string, _dst_ip string, _dst_port int, flow_end timestamp_ntz")
    a = spark.createDataFrame([("a", "b", 80, t + dt.timedelta(milliseconds=i), "X") for i in range(3000)], "_src_ip string, _dst_ip string, _dst_port int, alert_ts timestamp_ntz, label string")
    counted = labels.label_counts(f, a, 5.0)
    assert sum(r["times"] for r in counted.collect()) == 3000 * 3000
    assert 6000 <= most_rows(counted) <= 12_000  # flows and edge values, each row once


def test_flows_stay_out_of_the_ordering(spark):
    """Only different times of a key are ordered among its alerts, without the other columns of the flows that share them."""
    f = spark.sql("select id as flow_id, 'a' as _src_ip, 'b' as _dst_ip, 80 as _dst_port, timestamp_seconds(id % 3) as flow_end, repeat('x', 500) as payload from range(300)")
    a = spark.sql("select 'a' as _src_ip, 'b' as _dst_ip, 80 as _dst_port, timestamp_seconds(id) as alert_ts, 'SCAN' as label from range(2)")
    marks = labels._marks(a, "alert_ts", 5_000_000)
    rows = labels._entered(f, marks, marks.select(*labels.KEYS, "cell").distinct(), "flow_end", 5_000_000)
    assert not {"flow", "payload", "flow_id"} & set(rows.columns) and rows.where("met").count() == 3
    got = labels.label_counts(f, a, 2.0).groupBy("flow_end", "label", "times").count().collect()
    assert sorted((r["flow_end"].second, r["label"], r["times"], r["count"]) for r in got) == [(0, "SCAN", 2, 100), (1, "SCAN", 2, 100), (2, "SCAN", 1, 100)]


def test_cuts_descend_until_few_rows_are_ranked(spark):
    """Parts of no more than ten rows are ranked: the digest is read four digits further at a time."""
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    digest = F.concat(F.lit("abcd" * 3), F.md5(F.col("id").cast("string")))
    few = {r["g"]: r["cut"] for r in ranking.rank_cuts(df, F.col("g"), digest, F.floor(F.col("n") * 0.37), ranked_rows=10).collect()}
    ordered = sorted((r["g"], r["h"]) for r in df.select("g", digest.alias("h")).collect())
    for g in range(3):
        mine = [h for k, h in ordered if k == g]
        assert few[g] == mine[370 - 1]
    # One digest for all rows: nothing is left to tell them apart.
    same = ranking.rank_cuts(df, F.lit(0), F.lit("ab" * 16), F.lit(1500), ranked_rows=10).collect()
    assert [r["cut"] for r in same] == ["ab" * 16]


def test_one_stray_time_costs_its_bins_only(spark):
    rows = [(T0 + dt.timedelta(seconds=30 * i), 2) for i in (0, 1, 5)] + [(T0 + dt.timedelta(seconds=30 * 40_000), 1)]
    out = analytics.fill_bins(spark.createDataFrame(rows, "bin timestamp_ntz, n bigint"), "bin", 30)
    got = out.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 0), F.max("bin"), F.count_distinct("bin")).first()
    assert tuple(got) == (40_001, 7, 40_001 - 4, T0 + dt.timedelta(seconds=30 * 40_000), 40_001)
    assert analytics.fill_bins(spark.createDataFrame([], "bin timestamp_ntz, n bigint"), "bin", 30).count() == 0


def test_exact_auc(spark):
    rng = random.Random(31)
    rows = [(rng.choice([0.1, 0.5, 0.5, rng.random()]), rng.randint(0, 1)) for _ in range(400)] + [(None, 1), (float("nan"), 0), (0.5, None)]
    pos, neg = [[s for s, y in rows[:400] if y == k] for k in (1, 0)]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = ranking.exact_auc(spark.createDataFrame(rows, "s double, y int").repartition(5), "s", "y").first()
    assert abs(got["auc"] - want) < 1e-12 and (got["positives"], got["negatives"]) == (len(pos), len(neg))
    assert ranking.exact_auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()["auc"] is None


def test_headers_of_many_files_take_few_jobs(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03d}.csv").write_text("Destination Port, Label\n" + "80,BENIGN\n" * (1 + i % 3))
    (tmp_path / "empty.csv").write_text("")
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, group)
    frames = training_files._by_header(spark, str(tmp_path), False, "UTF-8")
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    # One job for the first lines, one for the column names, and one of Spark to list more than 32 paths for each.
    assert len(frames) == 1 and frames[0].count() == 600 and jobs <= 4
