import random

import simulate
from netloom.operators import flows as fl


def tcp(t, src, sp, dst, dp, n=60, **kw):
    return dict(t=t, src_ip=src, src_port=sp, dst_ip=dst, dst_port=dp, ip_len=n, **kw)


def test_golden_cases(make_packets):
    """Single packet, two directions of one flow, late SYN, zero duration."""
    rows = [
        tcp(0, "1.1.1.1", 9, "2.2.2.2", 80, syn=1),
        tcp(1, "10.0.0.1", 54321, "10.0.0.2", 80, syn=1), tcp(2, "10.0.0.2", 80, "10.0.0.1", 54321, syn=1, ack=1),
        tcp(1000.0, "192.168.1.10", 443, "8.8.8.8", 54321, 100, ack=1), tcp(1000.1, "8.8.8.8", 54321, "192.168.1.10", 443, 60, syn=1),
        tcp(50, "7.7.7.7", 1, "8.8.8.8", 2), tcp(50, "7.7.7.7", 1, "8.8.8.8", 2),
    ]
    out = {r["flow_id"]: r for r in fl.aggregate_flows(make_packets(rows), 60, ["192.168.0.0/16", "10.0.0.0/8"]).collect()}
    assert set(out) == {1, 3, 5}
    assert out[1]["direction"] == "internal" and out[1]["packet_count"] == 2
    late = out[3]
    assert (late["_src_ip"], late["src_bytes"], late["dst_bytes"], late["fwd_packet_count"], late["bwd_packet_count"]) == ("8.8.8.8", 60, 100, 1, 1)
    assert late["direction"] == "inbound" and late["flow_iat_max"] == 0
    assert abs(out[5]["flow_packets_per_sec"] - 2e6) < 1e-3 and out[5]["duration"] == 1e-6


def test_gap_is_strict(make_packets):
    rows = [tcp(t, "1.1.1.1", 1, "2.2.2.2", 2) for t in (0, 20, 40.000001, 50)]
    out = sorted(r["packet_count"] for r in fl.aggregate_flows(make_packets(rows), 20).collect())
    assert out == [2, 2]


def test_sensors_are_added(make_packets):
    rows = [tcp(1, "1.1.1.1", 1, "2.2.2.2", 80, 500, syn=1)]
    one, two = make_packets(rows), make_packets(rows)
    r = fl.aggregate_flows(fl.merge_sensors(one, two), 60).first()
    assert (r["packet_count"], r["src_bytes"]) == (2, 1000)


def random_packets(seed, n, keys=6, span=400.0, step=1e-6, hot=0.4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot else rnd.randrange(keys)
        a, b = (f"10.0.0.{k}", 1000 + k), (f"9.9.9.{k % 3}", 80)
        if rnd.random() < 0.4:
            a, b = b, a
        t = round(rnd.random() * span / step) * step
        rows.append(dict(tcp(round(t, 6), a[0], a[1], b[0], b[1], rnd.randrange(40, 1500), syn=int(rnd.random() < 0.15),
                             ack=int(rnd.random() < 0.3), rst=int(rnd.random() < 0.1)), packet_id=i, protocol=6))
    return rows


def test_against_sequential_model(make_packets):
    """Fine and coarse clocks (many ties), a hot key, slices much shorter than flows."""
    fine, coarse = random_packets(1, 400), random_packets(2, 600, span=300.0, step=1.0)
    shift = [dict(p, t=p["t"] + 10_000, packet_id=p["packet_id"] + 1000) for p in coarse]
    rows = fine + shift
    want = simulate.flows(rows, 7.0)
    df = make_packets(rows)
    simulate.same_flows(fl.aggregate_flows(df, 7.0).collect(), want)
    simulate.same_flows(fl.aggregate_flows(df, 7.0, slice_seconds=0.9).collect(), want)
    simulate.same_flows(fl.aggregate_flows(df, 7.0, combine_ties=False, slice_seconds=2).collect(), want)
    simulate.same_flows(fl.aggregate_flows(df, 7.0, combine_ties=False).collect(), want)


def test_mixed_capture(spark, make_packets):
    """Benign web traffic, a flood, a scan, odd ports and a beacon through the whole pipeline."""
    from pyspark.sql import functions as F

    from netloom.plans import detect

    rows, t = [], 0.0

    def add(dt, *a, **kw):
        nonlocal t
        rows.append(tcp(t, *a, **kw))
        t += dt

    S, SA, A, PA, FA = dict(syn=1), dict(syn=1, ack=1), dict(ack=1), dict(psh=1, ack=1), dict(fin=1, ack=1)
    for i in range(30):
        c, s, p = f"192.168.1.{10 + i % 20}", f"93.184.216.{34 + i % 5}", 50000 + i
        add(.001, c, p, s, 80, 40, **S), add(.001, s, 80, c, p, 40, **SA), add(.001, c, p, s, 80, 40, **A), add(.01, c, p, s, 80, 78, **PA)
        add(.01, s, 80, c, p, 571, **PA), add(.001, c, p, s, 80, 40, **FA), add(.002, s, 80, c, p, 40, **FA)
    for i in range(80):
        add(.005, "10.0.0.99", 20000 + i, "192.168.1.100", 80, 40, **S)
    for port in range(20, 45):
        add(.01, "10.0.0.50", 54321, "192.168.1.200", port, 40, **S), add(.005, "192.168.1.200", port, "10.0.0.50", 54321, 40, rst=1)
    for host, first, port, n in (("10.0.0.77", 60000, 445, 5), ("10.0.0.88", 61000, 4444, 3)):
        for i in range(n):
            p = first + i
            add(.01, host, p, "192.168.1.5", port, 40, **S), add(.01, "192.168.1.5", port, host, p, 40, **SA), add(.05, host, p, "192.168.1.5", port, 40, **A)
            add(.1, host, p, "192.168.1.5", port, 104, **PA), add(.01, host, p, "192.168.1.5", port, 40, **FA)
    for i in range(2):
        p = 62000 + i
        add(.01, "172.16.0.9", p, "192.168.1.1", 23, 40, **S), add(.01, "192.168.1.1", 23, "172.16.0.9", p, 40, **SA)
        add(.2, "172.16.0.9", p, "192.168.1.1", 23, 47, **PA), add(.01, "172.16.0.9", p, "192.168.1.1", 23, 40, **FA)
    for i in range(10):
        p = 63000 + i
        add(.05, "192.168.1.77", p, "185.220.101.1", 443, 40, **S), add(.05, "185.220.101.1", 443, "192.168.1.77", p, 40, **SA), add(30, "192.168.1.77", p, "185.220.101.1", 443, 40, **FA)

    assert len(rows) == 418
    cfg = detect.DetectConfig(home_nets=["192.168.0.0/16", "10.0.0.0/8", "172.16.0.0/12"])
    flows = detect.detect_flows(make_packets(rows), cfg).cache()
    assert flows.count() == 75
    assert dict(flows.groupBy("direction").count().collect()) == {"outbound": 40, "internal": 35}
    alerts = detect.detect_alerts(flows, cfg)
    hits = alerts.groupBy("signature_match").count().collect()
    assert [(r[0].split(":")[0], r[1]) for r in hits] == [("Metasploit listener (port 4444)", 3)]
    fired = detect.finish_alerts(alerts, cfg)
    row = fired.collect()
    assert len(row) == 1 and row[0]["severity"] == "high" and row[0]["label"] == "ATTACK"
    inc = detect.incidents_of(fired, cfg, F.lit("2024-01-02").cast("timestamp_ntz")).collect()
    assert [(i["src_ip"], i["alert_count"], i["status"]) for i in inc] == [("10.0.0.88", 1, "closed")]
    assert inc[0]["incident_id"] == row[0]["incident_id"]


def test_equal_addresses_that_turn(make_packets):
    """What came before the first opening SYN changes sides, also within one microsecond and across slices."""
    rows = [tcp(t, "127.0.0.1", 5000, "127.0.0.1", 80, n, syn=s) for t, n, s in ((0, 100, 0), (0.5, 40, 1), (1, 60, 0))]
    r = fl.aggregate_flows(make_packets(rows), 60).first()
    assert (r["fwd_packet_count"], r["bwd_packet_count"], r["src_bytes"], r["dst_bytes"], r["fwd_packet_len_max"], r["bwd_packet_len_max"]) == (2, 1, 100, 100, 60, 100)
    rows = [dict(p, src_ip="127.0.0.1", dst_ip="127.0.0.1") for p in random_packets(5, 400, step=0.5)]
    for slice_seconds in (None, 1.5):
        got = fl.aggregate_flows(make_packets(rows), 7.0, slice_seconds=slice_seconds).collect()
        simulate.same_flows(got, simulate.flows(rows, 7.0))
