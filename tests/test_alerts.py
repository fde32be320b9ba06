import datetime as dt
import ipaddress
import random

import simulate
from pyspark.sql import functions as F

from netloom.functions import net
from netloom.operators import alerts as al
from netloom.operators import blocking, dedup, incidents, intel

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(microseconds=round(s * 1e6))


def alert_frame(spark, rows):
    """rows: (id, seconds, src, severity)"""
    return spark.createDataFrame([(i, at(t), s, "9.9.9.9", 80, "ATTACK", sev) for i, t, s, sev in rows],
                                 "alert_id bigint, alert_ts timestamp_ntz, _src_ip string, _dst_ip string, _dst_port int, label string, severity string")


def test_severity_label_and_alerts(spark):
    df = spark.createDataFrame([(i, at(i), s, m) for i, (s, m) in enumerate([(.95, None), (.85, None), (.70, None), (.64, None), (.5, "R: x"), (0.0, "R: x"), (float("nan"), None)])],
                               "flow_id bigint, flow_end timestamp_ntz, score double, m string")
    assert [r[0] for r in df.select(al.severity_of(F.col("score"))).collect()] == ["high", "medium", "low", None, None, None, None]
    out = {r["alert_id"]: (r["severity"], r["label"]) for r in al.raise_alerts(df, F.col("m")).collect()}
    assert out == {0: ("high", "ATTACK"), 1: ("medium", "ATTACK"), 2: ("low", "ATTACK"), 4: ("high", "ATTACK"), 5: ("high", "ATTACK")}
    assert al.score_mode(True, False) == "rf_only"


def test_dedup_anchors(spark):
    rows = [(i, t, "1.1.1.1", "high") for i, t in enumerate((0, 30, 60, 61, 119, 120))]
    out = {r["alert_id"]: (r["suppressed_since_last"], r["suppression_note"]) for r in dedup.deduplicate(alert_frame(spark, rows), 60).collect()}
    assert out == {0: (0, None), 2: (1, "1 similar alert(s) suppressed in last 60s"), 5: (2, "2 similar alert(s) suppressed in last 60s")}


def test_dedup_against_sequential_model(spark):
    """A hot fingerprint, ties, blocks shorter and longer than the chains."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        k = 0 if rnd.random() < 0.5 else rnd.randrange(1, 40)
        t = rnd.random() * 900 if k % 2 else float(rnd.randrange(900))
        rows.append((i, round(t, 6), f"1.1.1.{k}", "low"))
    rows.sort(key=lambda r: (r[1], r[0]))
    want = {}
    for src in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == src]
        for i, held in simulate.fires([r[1] for r in mine], 7.0):
            want[mine[i][0]] = held
    df = alert_frame(spark, rows).repartition(5).cache()
    for blocks in (1, 3, 64):
        got = {r[0]: r[1] for r in dedup.fired_ids(df, 7.0, blocks).collect()}
        assert got == want, blocks


def test_dedup_tree_of_blocks(spark, monkeypatch):
    """Busy fingerprints over many levels, blocks cut by rows inside a window; no group is larger than its bound."""
    rnd = random.Random(6)
    rows = []
    for i in range(4000):
        k = rnd.choice([0, 0, 0, 1, 2, 3])
        t = {0: rnd.random() * 600, 1: rnd.randrange(600_000) / 1000, 2: 100 + rnd.random() * 3, 3: (i % 997) * 0.5}[k]
        rows.append((i, round(t, 6), f"1.1.1.{k}", "low"))
    rows.sort(key=lambda r: (r[1], r[0]))
    want = {}
    for src in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == src]
        for i, held in simulate.fires([r[1] for r in mine], 2.0):
            want[mine[i][0]] = held
    seen, plain = {}, dedup.stage

    def watched(df, name):
        out = plain(df, name)
        keys = {"blocks": ["fp", "block"], "busy": ["fp", "grp"]}.get(name)
        if keys:
            seen.setdefault(name, []).append(out.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(dedup, "stage", watched)
    df = alert_frame(spark, rows).repartition(5).cache()
    levels = []
    for block_windows, block_rows, group_rows in ((1, 40, 60), (1, 8, 24), (4, 25, 100)):
        seen.clear()
        got = {r[0]: r[1] for r in dedup.fired_ids(df, 2.0, block_windows, block_rows, group_rows).collect()}
        assert got == want
        assert max(seen["blocks"]) <= 2 * block_rows
        assert max(seen["busy"]) <= group_rows + 2 * block_rows
        levels.append(len(seen["busy"]))
    assert max(levels) >= 2


def test_whole_groups_keeps_groups_together():
    import pyarrow as pa

    fps, blocks = ["a"] * 3 + ["b"] * 5 + ["c"] + ["d"] * 4, [0] * 3 + [0] * 2 + [1] * 3 + [0] + [2] * 4
    table = pa.table({"fp": fps, "block": blocks, "i": list(range(13))})
    for size in (1, 2, 3, 5, 13):
        parts = list(dedup._whole_groups(table.to_batches(size), ["fp", "block"]))
        assert [i for p in parts for i in p["i"].to_pylist()] == list(range(13))
        seen = [set(zip(p["fp"].to_pylist(), p["block"].to_pylist())) for p in parts]
        assert sum(map(len, seen)) == len(set.union(*seen)) == 5


def test_incidents(spark):
    rows = [(0, 0, "1.1.1.1", "low"), (1, 50, "1.1.1.1", "medium"), (2, 60, "2.2.2.2", "high"), (3, 170, "1.1.1.1", "high"), (4, 270.5, None, "low")]
    df = alert_frame(spark, rows)
    out = sorted((r["src_ip"], r["start_time"], r["alert_count"], r["max_severity"], r["status"]) for r in incidents.correlate(df, 100, F.lit(str(at(160))).cast("timestamp_ntz")).collect())
    assert out == [("1.1.1.1", at(0), 2, "medium", "closed"), ("1.1.1.1", at(170), 1, "high", "active"), ("2.2.2.2", at(60), 1, "high", "active"), ("unknown", at(270.5), 1, "low", "active")]
    ids = {r["alert_id"]: r["incident_id"] for r in incidents.assign_incidents(df, 100).collect()}
    assert ids[0] == ids[1] != ids[3] and len(set(ids.values())) == 4


def test_incident_intel_is_the_newest(spark):
    df = alert_frame(spark, [(0, 0, "8.8.8.8", "low"), (1, 10, "8.8.8.8", "low"), (2, 0, "10.0.0.1", "low")])
    df = df.withColumns({"country": F.when(F.col("alert_id") == 0, "AA"), "threat_level": F.when(F.col("alert_id") == 1, "high").otherwise("none"), "city": F.lit("x"), "asn": F.lit("y")})
    out = {r["src_ip"]: (r["country"], r["threat_level"]) for r in incidents.correlate(df).collect()}
    assert out == {"8.8.8.8": (None, "high"), "10.0.0.1": (None, None)}


def test_intel(spark):
    lines = spark.createDataFrame([("# c",), ("  1.2.3.4 ; note",), ("",), ("\t5.6.7.8\tx",), ("1.2.3.4",), ("9.0.0.0/8",)], "value string")
    bl = intel.parse_feed(lines)
    assert {r["ip"] for r in bl.collect()} == {"1.2.3.4", "5.6.7.8", "9.0.0.0/8"}
    geo = spark.createDataFrame([("1.2.3.4", 1.0, 2.0, "A", "a", "c", "i", "AS1")], "ip string, lat double, lon double, country string, countryCode string, city string, isp string, asn string")
    df = spark.createDataFrame([("1.2.3.4",), ("10.0.0.1",), ("9.0.0.1",), (None,), ("172.16.0.1",)], "_src_ip string")
    out = {r["_src_ip"]: (r["is_malicious"], r["threat_level"], r["country"]) for r in intel.enrich(df, bl, geo).collect()}
    assert out == {"1.2.3.4": (True, "high", "A"), "10.0.0.1": (None, None, None), "9.0.0.1": (False, "none", None), None: (None, None, None), "172.16.0.1": (False, "none", None)}


def test_network_lookup(spark):
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), ("10.1.2.3",), ("10.1.2.3/8",), ("0.0.0.0/0",)], "cidr string")
    df = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("11.0.0.1",), ("bad",)], "ip string")
    out = {r["ip"]: r["cidr"] for r in intel.locate_by_network(df, nets, "ip").collect()}
    assert out == {"10.1.2.3": "10.1.2.3", "10.1.9.9": "10.1.0.0/16", "11.0.0.1": "0.0.0.0/0", "bad": None}
    assert {r["ip"]: r["inside"] for r in intel.in_networks(df, nets, "ip", "inside").collect()}["bad"] is False


def test_addresses_of_both_families(spark):
    rng = random.Random(41)
    words = ["::", "::1", "fe80::1%eth0", "2001:db8::", "2001:DB8:0:0:1::ff", "1:2:3:4:5:6:7:8", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "10.1.2.3", "255.255.255.255", "",
             "1::2::3", "12345::", "::g", "1:2:3", "::256.1.1.1", "10.1.2", ":1::", "x"]
    words += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(200)]
    nets = ["2001:db8::/32", "2001:db8::/48", "::/0", "8000::/1", "fe80::/10", "10.0.0.0/8", "10.1.2.3", "::1", "0.0.0.0/0", "::ffff:10.0.0.0/104", "2001:db8::1/32", "10.0.0.1/8", "::/129", "::/-1", "bad"]

    def address(text):
        try:
            return ipaddress.ip_address(text.split("%")[0])
        except ValueError:
            return None

    def network(text):
        try:
            return ipaddress.ip_network(text)
        except ValueError:
            return None

    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "ip string")
    got = {r["ip"]: r["p"] for r in df.select("ip", net.ip_parts(F.col("ip")).alias("p")).collect()}
    for w in words:
        a = address(w)
        assert (got[w] is None) == (a is None), w
        if a is not None:
            assert (got[w]["family"], (got[w]["hi"] % 2**64 << 64) + got[w]["lo"] % 2**64) == (a.version, int(a)), w
    found = {}
    for r in intel.network_matches(df, spark.createDataFrame([(n,) for n in nets], "cidr string"), "ip").collect():
        found.setdefault(r["ip"], set()).add((r["cidr"], r["prefix_length"]))
    known = {n: network(n) for n in nets if network(n) is not None}
    for w in words:
        a = address(w)
        want = {(n, k.prefixlen) for n, k in known.items() if a is not None and a.version == k.version and a in k}
        assert found.get(w, set()) == want, w
    flows = spark.createDataFrame([("2001:db8::5", "2001:db9::1"), ("8.8.8.8", "2001:db8::9"), ("10.0.0.1", "2001:db8::9"), ("fe80::1", "1::"), ("?", "1::")], "_src_ip string, _dst_ip string")
    told = [r["direction"] for r in net.with_direction(flows, ["2001:db8::/32", "10.0.0.0/8"]).collect()]
    assert told == ["outbound", "inbound", "internal", "external", "uncertain"]


def test_blocked_set(spark):
    rows = [(at(1), "block", "8.8.8.8"), (at(2), "block", "10.0.0.1"), (at(3), "unblock", "8.8.8.8"), (at(4), "block", "8.8.8.8"), (at(1), "block", "9.9.9.9"), (at(2), "unblock", "9.9.9.9"), (at(3), "drop", "9.9.9.9"), (at(3), "block", "")]
    b = blocking.blocked_addresses(spark.createDataFrame(rows, "ts timestamp_ntz, action string, ip string"))
    assert [r["ip"] for r in b.collect()] == ["8.8.8.8"]
