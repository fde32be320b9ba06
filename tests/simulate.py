"""Plain sequential models of the stateful operators, for comparison on small inputs."""

import math


def flows(packets, gap, home=()):
    """Flow rows of packets (dicts with t, packet_id and packet fields), one at a time in time order."""
    done, open_flows = [], {}
    for p in sorted(packets, key=lambda p: (p["t"], p["packet_id"])):
        a, b = (p["src_ip"], p["src_port"] or 0), (p["dst_ip"], p["dst_port"] or 0)
        key = (min(a, b), max(a, b), p["protocol"])
        f = open_flows.get(key)
        if f and p["t"] - f["last"] > gap:
            done.append(f)
            f = None
        opens = p.get("syn", 0) == 1 and p.get("ack", 0) == 0
        if f is None:
            f = open_flows[key] = dict(id=p["packet_id"], start=p["t"], src=a, dst=b, settled=opens, iats=[], pk=[], fwd=[], bwd=[], last=p["t"])
        elif opens and not f["settled"]:
            f["src"], f["dst"], f["settled"] = f["dst"], f["src"], True
            f["fwd"], f["bwd"] = f["bwd"], f["fwd"]
        else:
            f["iats"].append(p["t"] - f["last"])
        f["last"] = p["t"]
        f["pk"].append(p)
        f["fwd" if p["src_ip"] == f["src"][0] else "bwd"].append(p["ip_len"])
    done += open_flows.values()
    return {f["id"]: _row(f) for f in done if len(f["pk"]) >= 2}


def _row(f):
    n, pk = len(f["pk"]), f["pk"]
    fwd, bwd = f["fwd"], f["bwd"]
    lens = [p["ip_len"] for p in pk]
    dur = f["last"] - f["start"]
    dur = dur if dur > 0 else 1e-6
    mean = sum(lens) / n
    im = sum(f["iats"]) / (n - 1)
    iv = sum(x * x for x in f["iats"]) / (n - 1) - im * im
    flag = lambda k: sum(p.get(k, 0) for p in pk)
    return dict(
        dst_port=f["dst"][1], duration=round(dur, 6), src_bytes=sum(fwd), dst_bytes=sum(bwd), packet_count=n,
        fwd_packet_count=len(fwd), bwd_packet_count=len(bwd), avg_packet_len=mean,
        std_packet_len=math.sqrt(max(0, sum(x * x for x in lens) / n - mean * mean)),
        flow_bytes_per_sec=sum(lens) / dur, flow_packets_per_sec=n / dur,
        fwd_packet_len_max=max(fwd, default=0), bwd_packet_len_max=max(bwd, default=0),
        flow_iat_mean=im, flow_iat_std=math.sqrt(max(0, iv)), flow_iat_max=max(f["iats"], default=0), flow_iat_min=min(f["iats"], default=0),
        syn_flag_count=flag("syn"), ack_flag_count=flag("ack"), rst_flag_count=flag("rst"),
        _src_ip=f["src"][0], _dst_ip=f["dst"][0], _src_port=f["src"][1], _dst_port=f["dst"][1])


def same_flows(got, want, tol=1e-5):
    assert {r["flow_id"] for r in got} == set(want)
    for r in got:
        for k, v in want[r["flow_id"]].items():
            g = r[k]
            ok = g == v if isinstance(v, str) else abs(g - v) <= tol * max(1.0, abs(v))
            assert ok, (r["flow_id"], k, g, v)


def fires(times, window):
    """Indices that fire and how many were held back before each; times sorted."""
    out, last, held = [], None, 0
    for i, t in enumerate(times):
        if last is None or t - last >= window:
            out.append((i, held))
            last, held = t, 0
        else:
            held += 1
    return out
