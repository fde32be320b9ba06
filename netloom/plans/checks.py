"""SQL statements of the catalogue queries, written independently for a single-node database.

Common table expressions build the same stages in the plain sequential way (row by row over sorted
windows, recursion for suppression), so they share no method with the operators.
"""

from __future__ import annotations

from netloom.plans.views import DEDUP_SECONDS, GAP_SECONDS, INCIDENT_SECONDS

_KEY = "lo_ip, lo_port, hi_ip, hi_port, protocol"


def _packets(source: str = "events") -> str:
    return f"""
ev AS (SELECT event_id, ts, user_id AS u, event_type AS et, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k FROM {source}),
ends AS (SELECT *, k % 3 <> 0 AS fwd,
  (CASE WHEN u % 4 = 0 THEN '203.0.113.' ELSE '10.0.0.' END) || CAST(u % 200 AS VARCHAR) AS client,
  CASE WHEN u % 5 = 0 THEN '198.51.100.7' ELSE '192.168.1.' || CAST(u % 7 AS VARCHAR) END AS server,
  CAST(50000 + u AS INTEGER) AS cport,
  CAST([22, 23, 80, 443, 445, 3389, 4444, 53, 21, 6667][u % 10 + 1] AS INTEGER) AS sport FROM ev),
packets AS (SELECT event_id AS packet_id, ts,
  CASE WHEN fwd THEN client ELSE server END AS src_ip, CASE WHEN fwd THEN server ELSE client END AS dst_ip,
  CASE WHEN fwd THEN cport ELSE sport END AS src_port, CASE WHEN fwd THEN sport ELSE cport END AS dst_port,
  CASE WHEN u % 7 = 0 THEN 17 ELSE 6 END AS protocol, CAST(40 + 14 * k AS BIGINT) AS ip_len,
  CASE WHEN et = 'purchase' AND k % 5 = 0 THEN 1 ELSE 0 END AS fin,
  CASE WHEN et IN ('signup', 'click') THEN 1 ELSE 0 END AS syn,
  CASE WHEN et = 'error' THEN 1 ELSE 0 END AS rst,
  CASE WHEN et = 'purchase' AND k % 4 = 0 THEN 1 ELSE 0 END AS psh,
  CASE WHEN et IN ('view', 'purchase') OR (et = 'click' AND k % 2 = 0) THEN 1 ELSE 0 END AS ack,
  1 AS sensor FROM ends)"""


def _flows(source: str = "packets", orient: str = "first_syn") -> str:
    one_way = "CASE WHEN src_ip = dst_ip THEN " + ("NOT (turns AND rn < open_rn) ELSE " if orient == "first_syn" else "true ELSE ")
    src_flip = "turns" if orient == "first_syn" else "turns AND open_src_lo <> head_src_lo"
    return f"""
keyed AS (SELECT *, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS src_lo, epoch_us(ts) AS us FROM {source}),
pairs AS (SELECT *, CASE WHEN src_lo THEN src_ip ELSE dst_ip END AS lo_ip, CASE WHEN src_lo THEN src_port ELSE dst_port END AS lo_port,
  CASE WHEN src_lo THEN dst_ip ELSE src_ip END AS hi_ip, CASE WHEN src_lo THEN dst_port ELSE src_port END AS hi_port FROM keyed),
gaps AS (SELECT *, lag(us) OVER (PARTITION BY {_KEY} ORDER BY us, packet_id, sensor) AS prev FROM pairs),
sess AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > {GAP_SECONDS * 1000000} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {_KEY} ORDER BY us, packet_id, sensor) AS sid FROM gaps),
numbered AS (SELECT *, syn = 1 AND ack = 0 AS opens, row_number() OVER (PARTITION BY {_KEY}, sid ORDER BY us, packet_id, sensor) AS rn FROM sess),
marked AS (SELECT *, first_value(opens) OVER w AS head_opens, first_value(src_lo) OVER w AS head_src_lo,
  min(CASE WHEN opens THEN rn END) OVER (PARTITION BY {_KEY}, sid) AS open_rn FROM numbered
  WINDOW w AS (PARTITION BY {_KEY}, sid ORDER BY rn)),
turned AS (SELECT *, NOT head_opens AND open_rn IS NOT NULL AS turns,
  bool_or(rn = open_rn AND src_lo) OVER (PARTITION BY {_KEY}, sid) AS open_src_lo FROM marked),
sided AS (SELECT *, CASE WHEN {src_flip} THEN NOT head_src_lo ELSE head_src_lo END AS from_lo FROM turned),
timed AS (SELECT *, {one_way}(src_lo = from_lo) END AS is_fwd, CASE WHEN rn > 1 AND NOT (turns AND rn = open_rn) THEN us - prev END AS iat_us FROM sided),
sums AS (SELECT {_KEY}, sid, bool_or(from_lo) AS from_lo, count(*) AS n, min(CASE WHEN rn = 1 THEN packet_id END) AS flow_id,
  min(ts) AS t0, max(ts) AS t1, max(us) - min(us) AS span, sum(ip_len)::DOUBLE AS len, sum(ip_len * ip_len)::DOUBLE AS sq,
  sum(CASE WHEN is_fwd THEN ip_len ELSE 0 END)::DOUBLE AS fb, sum(CASE WHEN is_fwd THEN 0 ELSE ip_len END)::DOUBLE AS bb,
  count(*) FILTER (is_fwd) AS fc, count(*) FILTER (NOT is_fwd) AS bc,
  coalesce(max(ip_len) FILTER (is_fwd), 0)::DOUBLE AS fm, coalesce(max(ip_len) FILTER (NOT is_fwd), 0)::DOUBLE AS bm,
  coalesce(sum(iat_us), 0)::BIGINT / 1000000::DOUBLE AS si, coalesce(sum((iat_us / 1000000::DOUBLE) * (iat_us / 1000000::DOUBLE)), 0) AS sqi,
  coalesce(max(iat_us), 0) / 1000000::DOUBLE AS mxi, coalesce(min(iat_us), 0) / 1000000::DOUBLE AS mni,
  sum(fin)::BIGINT AS fin, sum(syn)::BIGINT AS syn, sum(rst)::BIGINT AS rst, sum(psh)::BIGINT AS psh, sum(ack)::BIGINT AS ack
  FROM timed GROUP BY {_KEY}, sid HAVING count(*) >= 2),
ratio AS (SELECT *, CASE WHEN span > 0 THEN span / 1000000.0::DOUBLE ELSE 0.000001::DOUBLE END AS dur FROM sums),
flows0 AS (SELECT flow_id, CASE WHEN from_lo THEN hi_port ELSE lo_port END AS dst_port, dur AS duration, fb AS src_bytes, bb AS dst_bytes,
  n AS packet_count, len / n AS avg_packet_len, sqrt(greatest(0::DOUBLE, sq / n - (len / n) * (len / n))) AS std_packet_len,
  len / dur AS flow_bytes_per_sec, n / dur AS flow_packets_per_sec, fm AS fwd_packet_len_max, bm AS bwd_packet_len_max,
  si / (n - 1) AS flow_iat_mean, sqrt(greatest(0::DOUBLE, sqi / (n - 1) - (si / (n - 1)) * (si / (n - 1)))) AS flow_iat_std,
  mxi AS flow_iat_max, mni AS flow_iat_min, fin AS fin_flag_count, syn AS syn_flag_count, rst AS rst_flag_count, psh AS psh_flag_count,
  ack AS ack_flag_count, fc AS fwd_packet_count, bc AS bwd_packet_count,
  CASE WHEN from_lo THEN lo_ip ELSE hi_ip END AS _src_ip, CASE WHEN from_lo THEN hi_ip ELSE lo_ip END AS _dst_ip,
  CASE WHEN from_lo THEN lo_port ELSE hi_port END AS _src_port, CASE WHEN from_lo THEN hi_port ELSE lo_port END AS _dst_port,
  protocol, t0 AS _timestamp, t1 AS flow_end FROM ratio),
homes AS (SELECT *, _src_ip LIKE '10.%' OR _src_ip LIKE '192.168.%' AS s_in, _dst_ip LIKE '10.%' OR _dst_ip LIKE '192.168.%' AS d_in FROM flows0),
flows AS (SELECT * EXCLUDE (s_in, d_in), CASE WHEN s_in AND d_in THEN 'internal' WHEN s_in THEN 'outbound' WHEN d_in THEN 'inbound' ELSE 'external' END AS direction FROM homes)"""


_RULES = [
    ("V_SYN", "Syn burst", "many openings, few answers", "high", "dos", "syn_flag_count > 3 AND ack_flag_count < 2"),
    ("V_PORT", "Bad port", "backdoor or chat port", "high", "c2,suspicious", "_dst_port IN (4444, 6667)"),
    ("V_RST", "Reset scan", "resets from outside", "medium", "scan", "rst_flag_count >= 2 AND direction = 'inbound'"),
    ("V_UPLOAD", "Upload", "large and lasting", "medium", "exfil",
     "src_bytes >= 2500 AND packet_count <= 5 AND direction <> 'internal' AND _dst_port NOT IN (53, 80, 443)"),
    ("V_HOST", "Watched host", "documentation range", "low", "suspicious", "contains(_dst_ip, '198.51') AND fin_flag_count <> 0"),
]
_SHIPPED = [
    ("SYN_FLOOD_001", "high", 3, True, "syn_flag_count > 50 AND ack_flag_count < 5 AND direction = 'inbound'"),
    ("HIGH_VOLUME_001", "high", 1, True, "flow_bytes_per_sec > 10000000"),
    ("UDP_FLOOD_001", "high", 2, True, "flow_packets_per_sec > 500 AND avg_packet_len < 100"),
    ("PORT_SCAN_001", "medium", 2, True, "rst_flag_count > 20 AND direction = 'inbound'"),
    ("FIN_SCAN_001", "medium", 4, True, "fin_flag_count > 5 AND syn_flag_count = 0 AND ack_flag_count = 0 AND direction = 'inbound'"),
    ("NULL_SCAN_001", "medium", 7, True, "syn_flag_count = 0 AND ack_flag_count = 0 AND fin_flag_count = 0 AND rst_flag_count = 0 AND psh_flag_count = 0 AND packet_count > 5 AND direction = 'inbound'"),
    ("C2_BEACON_001", "high", 4, True, "packet_count <= 3 AND duration < 0.5 AND direction = 'outbound' AND _dst_port NOT IN (53, 80, 443, 123)"),
    ("C2_BEACON_002", "medium", 3, True, "duration > 300 AND src_bytes < 1000 AND direction = 'outbound'"),
    ("BAD_PORT_TELNET", "medium", 2, True, "_dst_port = 23 AND direction = 'inbound'"),
    ("BAD_PORT_SMB", "high", 2, True, "_dst_port = 445 AND direction = 'inbound'"),
    ("BAD_PORT_RDP", "medium", 2, True, "_dst_port = 3389 AND direction = 'inbound'"),
    ("BAD_PORT_VNC", "low", 1, True, "_dst_port = 5900"),
    ("BAD_PORT_IRC", "high", 1, True, "_dst_port = 6667"),
    ("BAD_PORT_METERPRETER", "high", 1, True, "_dst_port = 4444"),
    ("BAD_PORT_BACKCONNECT", "high", 1, True, "_dst_port IN (31337, 12345)"),
    ("BRUTEFORCE_SSH_001", "high", 4, True, "_dst_port = 22 AND syn_flag_count > 20 AND duration < 30 AND direction = 'inbound'"),
    ("BRUTEFORCE_FTP_001", "medium", 2, True, "_dst_port = 21 AND syn_flag_count > 15"),
    ("EXFIL_LARGE_UPLOAD_001", "medium", 3, True, "src_bytes > 5000000 AND flow_bytes_per_sec > 500000 AND direction = 'outbound'"),
]
_SIG = "CASE " + " ".join(f"WHEN {c} THEN '{n}: {d}'" for _, n, d, _, _, c in _RULES) + " END"
_META = " UNION ALL ".join(
    f"SELECT flow_id, '{i}' AS rule_id, '{n}' AS name, '{s}' AS severity, '{t}' AS tags, '{d}' AS description FROM flows WHERE {c}"
    for i, n, d, s, t, c in _RULES)
_SHIPPED_HITS = " UNION ALL ".join(f"SELECT '{i}' AS rule_id, '{s}' AS severity FROM flows WHERE {c}" for i, s, _, _, c in _SHIPPED)

_SCORED = """
sc AS (SELECT *, CAST(flow_id % 100 AS DOUBLE) / CAST(99 AS DOUBLE) AS rf_score, CAST((flow_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS ae_score FROM flows),
scored AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, rf_score * 0.65::DOUBLE + ae_score * 0.35::DOUBLE)) AS score FROM sc)"""

_ALERTS = f"""
sevd AS (SELECT *, CASE WHEN score >= 0.92::DOUBLE THEN 'high' WHEN score >= 0.80::DOUBLE THEN 'medium' WHEN score >= 0.65::DOUBLE THEN 'low' END AS sev,
  {_SIG} AS signature_match FROM scored),
alerts AS (SELECT *, flow_id AS alert_id, flow_end AS alert_ts, 'ATTACK' AS label,
  CASE WHEN signature_match IS NOT NULL THEN 'high' ELSE sev END AS severity FROM sevd WHERE sev IS NOT NULL OR signature_match IS NOT NULL)"""

_FIRED = f"""
ranked AS (SELECT alert_id, alert_ts, concat_ws('|', _src_ip, _dst_ip, _dst_port, label) AS fp,
  row_number() OVER (PARTITION BY _src_ip, _dst_ip, _dst_port, label ORDER BY alert_ts, alert_id) AS r FROM alerts),
chain AS (
  SELECT fp, r, alert_id, alert_ts AS last_fired, 0 AS held, true AS fires, 0 AS suppressed FROM ranked WHERE r = 1
  UNION ALL
  SELECT x.fp, x.r, x.alert_id,
    CASE WHEN x.alert_ts - c.last_fired >= INTERVAL {DEDUP_SECONDS} SECOND THEN x.alert_ts ELSE c.last_fired END,
    CASE WHEN x.alert_ts - c.last_fired >= INTERVAL {DEDUP_SECONDS} SECOND THEN 0 ELSE c.held + 1 END,
    x.alert_ts - c.last_fired >= INTERVAL {DEDUP_SECONDS} SECOND,
    CASE WHEN x.alert_ts - c.last_fired >= INTERVAL {DEDUP_SECONDS} SECOND THEN c.held ELSE 0 END
  FROM chain c JOIN ranked x ON x.fp = c.fp AND x.r = c.r + 1),
fired AS (SELECT a.*, c.suppressed AS suppressed_since_last,
  CASE WHEN c.suppressed > 0 THEN CAST(c.suppressed AS VARCHAR) || ' similar alert(s) suppressed in last {DEDUP_SECONDS}s' END AS suppression_note
  FROM alerts a JOIN chain c ON a.alert_id = c.alert_id WHERE c.fires)"""

_BLOCKLIST = """
feed AS (SELECT c_custkey AS key, c_name, (CASE WHEN c_custkey % 3 = 0 THEN '203.0.113.' ELSE '10.0.0.' END) || CAST(c_custkey % 200 AS VARCHAR) AS ip FROM customer),
blocklist AS (SELECT DISTINCT CASE WHEN key % 10 = 9 THEN ip || '/32' ELSE ip END AS ip FROM feed WHERE key % 10 IN (2, 3, 4, 9))"""

_GEO = """
hosts AS (SELECT c_custkey % 160 AS host, min(c_nationkey) AS k FROM customer GROUP BY 1),
geo AS (SELECT net || CAST(host AS VARCHAR) AS ip, CAST(k * 2.5 AS DOUBLE) AS lat, CAST(k * -3.25 AS DOUBLE) AS lon, n_name AS country,
  'C' || CAST(k AS VARCHAR) AS "countryCode", CASE WHEN k % 4 = 0 THEN '' ELSE 'City ' || CAST(k AS VARCHAR) END AS city,
  'ISP ' || CAST(k % 5 AS VARCHAR) AS isp, 'AS' || CAST(k + 64500 AS VARCHAR) AS asn
  FROM hosts JOIN nation ON k = n_nationkey, (VALUES ('203.0.113.'), ('198.51.100.')) v(net))"""

_SKIP = "(_src_ip LIKE '192.168.%' OR _src_ip LIKE '10.%' OR _src_ip = '127.0.0.1')"
_ENRICHED = f"""
enriched AS (SELECT f.*, CASE WHEN NOT {_SKIP} THEN b.ip IS NOT NULL END AS is_malicious,
  CASE WHEN NOT {_SKIP} THEN CASE WHEN b.ip IS NOT NULL THEN 'high' ELSE 'none' END END AS threat_level,
  g.country, g.city, g.isp, g.asn, NOT {_SKIP} AS has_intel
  FROM fired f LEFT JOIN blocklist b ON f._src_ip = b.ip AND NOT {_SKIP} LEFT JOIN geo g ON f._src_ip = g.ip AND NOT {_SKIP})"""


def _incidents(source: str, intel: bool) -> str:
    newest = ", ".join(f"max(CASE WHEN latest THEN {c} END) AS {c}" if intel else f"NULL::VARCHAR AS {c}" for c in ("country", "city", "asn", "threat_level"))
    flag = f"""row_number() OVER (PARTITION BY _src_ip, sess ORDER BY CASE WHEN has_intel THEN 0 ELSE 1 END, alert_ts DESC, alert_id DESC) = 1 AND has_intel""" if intel else "false"
    return f"""
ig AS (SELECT *, lag(alert_ts) OVER (PARTITION BY _src_ip ORDER BY alert_ts, alert_id) AS prev_ts FROM {source}),
isess AS (SELECT *, sum(CASE WHEN prev_ts IS NULL OR alert_ts - prev_ts > INTERVAL {INCIDENT_SECONDS} SECOND THEN 1 ELSE 0 END)
  OVER (PARTITION BY _src_ip ORDER BY alert_ts, alert_id) AS sess FROM ig),
ilast AS (SELECT *, {flag} AS latest, min(alert_ts) OVER (PARTITION BY _src_ip, sess) AS opened FROM isess),
iids AS (SELECT *, CAST('0x' || substr(md5(_src_ip || '|' || CAST(epoch_us(opened) AS VARCHAR)), 1, 15) AS BIGINT) AS incident_id FROM ilast),
incidents AS (SELECT incident_id, min(alert_ts) AS start_time, max(alert_ts) AS end_time, _src_ip AS src_ip, count(*) AS alert_count,
  CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS max_severity,
  CASE WHEN (SELECT max(ts) FROM events) - max(alert_ts) > INTERVAL {INCIDENT_SECONDS} SECOND THEN 'closed' ELSE 'active' END AS status,
  {newest} FROM iids GROUP BY incident_id, _src_ip, sess)"""


_NETWORKS = """
netk AS (SELECT n_nationkey AS k FROM nation),
nets0 AS (SELECT '203.0.113.' || CAST(k * 8 AS VARCHAR) || '/29' AS cidr FROM netk UNION SELECT '10.0.' || CAST(k % 3 AS VARCHAR) || '.0/24' FROM netk
  UNION SELECT CASE WHEN k % 7 = 0 THEN '10.0.0.' || CAST(k + 1 AS VARCHAR) || '/8' ELSE '192.168.0.0/16' END FROM netk
  UNION SELECT '198.51.100.' || CAST(k AS VARCHAR) FROM netk),
netp AS (SELECT cidr, string_split(split_part(cidr, '/', 1), '.') AS p, CASE WHEN contains(cidr, '/') THEN CAST(split_part(cidr, '/', 2) AS INTEGER) ELSE 32 END AS len FROM nets0),
netr AS (SELECT cidr, len, CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT) AS lo, CAST(1 AS BIGINT) << (32 - len) AS size FROM netp),
nets AS (SELECT * FROM netr WHERE lo % size = 0)"""


def _number(col: str) -> str:
    return " + ".join(f"CAST(split_part({col}, '.', {i}) AS BIGINT) * {m}" for i, m in ((1, 16777216), (2, 65536), (3, 256), (4, 1)))


_TRAIN = """
li AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_id,
  CASE WHEN l_returnflag = 'N' THEN 'BENIGN' WHEN l_returnflag = 'A' THEN 'Benign' WHEN l_linenumber = 7 THEN NULL ELSE 'DDoS' END AS label,
  l_quantity + l_linenumber AS packets, l_quantity + 1 AS iat, l_partkey % 1024 AS port,
  l_discount = 0 OR l_tax = 0 AS has_inf, l_discount = 0 AS inf_rate, l_suppkey % 50 = 0 AS has_nan, l_suppkey % 60 = 1 AS has_null,
  l_extendedprice * l_discount AS rate, l_extendedprice AS price FROM lineitem),
strict AS (SELECT *, CASE WHEN upper(label) <> 'BENIGN' THEN 1 ELSE 0 END AS is_attack FROM li WHERE label IS NOT NULL AND NOT has_inf AND NOT has_nan AND NOT has_null)"""

_NEAR = """
moved AS (SELECT alert_id, _src_ip, _dst_ip, _dst_port, label, alert_ts + to_seconds((alert_id % 7 - 3) * 2) AS alert_ts FROM alerts),
near AS (SELECT * FROM moved UNION ALL SELECT * FROM moved WHERE alert_id % 3 = 0),
labelled AS (SELECT f.flow_id, f._dst_port, coalesce(a.label, 'BENIGN') AS label FROM flows f LEFT JOIN near a
  ON f._src_ip = a._src_ip AND f._dst_ip = a._dst_ip AND f._dst_port = a._dst_port AND abs(epoch_us(f.flow_end) - epoch_us(a.alert_ts)) < 5000000)"""

_LOG = """
rec AS (SELECT event_id, user_id AS k, CAST(event_id % 100 AS DOUBLE) / 99::DOUBLE AS score FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0),
logs AS (SELECT event_id, CAST(CASE WHEN event_id % 6 <> 0 THEN event_id + 1000 WHEN event_id % 12 <> 0 THEN event_id + 5000 ELSE 0 END AS DOUBLE) AS timestamp,
  '10.0.0.' || CAST(k % 200 AS VARCHAR) AS src_ip, '192.168.1.' || CAST(k % 7 AS VARCHAR) AS dst_ip,
  CASE WHEN k % 5 = 0 OR k % 1024 = 0 THEN k % 4096 ELSE k % 1024 END AS dst_port, score FROM rec)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + " "


def _base() -> str:
    return _packets() + "," + _flows()


F_ = _base()
S_ = F_ + "," + _SCORED
A_ = S_ + "," + _ALERTS
D_ = A_ + "," + _FIRED
E_ = D_ + "," + _BLOCKLIST + "," + _GEO + "," + _ENRICHED
_DOUBLES = ["duration", "src_bytes", "dst_bytes", "avg_packet_len", "std_packet_len", "flow_bytes_per_sec", "flow_packets_per_sec",
            "fwd_packet_len_max", "bwd_packet_len_max", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min"]
_R = ", ".join(f"round({c} + 0.000000003::DOUBLE, 6) AS {c}" for c in _DOUBLES)
_FLOW_SELECT = f"SELECT * REPLACE ({_R}) FROM flows"
_BLOCKED = """
cmds AS (SELECT p.ts, p.packet_id, p.src_ip AS ip, CASE e.event_type WHEN 'click' THEN 'block' WHEN 'error' THEN 'unblock' ELSE 'noop' END AS action
  FROM packets p JOIN events e ON p.packet_id = e.event_id),
okcmds AS (SELECT * FROM cmds WHERE action = 'unblock' OR (action = 'block' AND ip NOT LIKE '10.%' AND ip NOT LIKE '192.168.%')),
lastcmd AS (SELECT ip, action, row_number() OVER (PARTITION BY ip ORDER BY ts DESC, packet_id DESC) AS r FROM okcmds),
blocked AS (SELECT ip FROM lastcmd WHERE r = 1 AND action = 'block')"""
_LINKS = """
links AS (SELECT _src_ip, _dst_ip, count(*) AS value FROM flows GROUP BY ALL),
tops AS (SELECT _src_ip FROM links GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 6),
topd AS (SELECT _dst_ip FROM links GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 6),
toplinks AS (SELECT * FROM links WHERE _src_ip IN (SELECT * FROM tops) AND _dst_ip IN (SELECT * FROM topd)),
nodes AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT _src_ip AS node FROM toplinks UNION SELECT _dst_ip FROM toplinks))"""


def _top(source: str, column: str, n: int) -> str:
    return f"SELECT {column}, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, 1 LIMIT {n}"


def _quant(source: str, col: str, probs: list[float], digits: int = 4) -> str:
    return " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round(quantile_cont({col}, {p}), {digits}) AS value FROM {source}" for p in probs)


_UPTIME = """CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END"""

SQL: dict[str, str] = {
    "packets_decode": """
WITH e AS (SELECT *, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k FROM events),
p AS (SELECT event_id AS packet_id, user_id, k, CASE k % 3 WHEN 0 THEN 17 WHEN 1 THEN 6 ELSE 1 END AS protocol FROM e WHERE k % 10 <> 0),
b AS (SELECT *, CASE WHEN protocol = 6 THEN k % 64 ELSE 0 END AS flags FROM p)
SELECT packet_id, CASE WHEN protocol IN (6, 17) THEN CAST(50000 + user_id AS INTEGER) END AS src_port, CASE WHEN protocol IN (6, 17) THEN 80 END AS dst_port, protocol,
  CAST(flags & 1 AS INTEGER) AS fin, CAST((flags >> 1) & 1 AS INTEGER) AS syn, CAST((flags >> 2) & 1 AS INTEGER) AS rst,
  CAST((flags >> 3) & 1 AS INTEGER) AS psh, CAST((flags >> 4) & 1 AS INTEGER) AS ack, CAST((flags >> 5) & 1 AS INTEGER) AS urg FROM b""",
    "flows_all": _with(F_) + _FLOW_SELECT,
    "flows_untied": _with(F_) + _FLOW_SELECT,
    "flows_loopback": _with(_packets(), "loop AS (SELECT * REPLACE ('127.0.0.1' AS src_ip, '127.0.0.1' AS dst_ip) FROM packets)", _flows("loop")) + _FLOW_SELECT,
    "flows_syn_sender": _with(_packets(), _flows(orient="syn_sender")) + "SELECT flow_id, _src_ip, _src_port, _dst_ip, _dst_port, src_bytes, dst_bytes, direction FROM flows",
    "flows_multi_sensor": _with(_packets(), """
twice AS (SELECT * FROM packets UNION ALL SELECT * REPLACE (2 AS sensor) FROM packets WHERE syn = 1 OR rst = 1)""", _flows("twice")) + """
SELECT flow_id, packet_count, src_bytes, dst_bytes, fwd_packet_count, bwd_packet_count, syn_flag_count, rst_flag_count,
  round(flow_iat_mean + 0.000000003::DOUBLE, 6) AS flow_iat_mean, round(flow_iat_std + 0.000000003::DOUBLE, 6) AS flow_iat_std, round(flow_iat_max + 0.000000003::DOUBLE, 6) AS flow_iat_max, round(flow_iat_min + 0.000000003::DOUBLE, 6) AS flow_iat_min FROM flows""",
    "flow_direction": _with(F_) + "SELECT direction, count(*) AS n FROM flows GROUP BY 1",
    "features_clean": _with(F_) + """
SELECT flow_id, dst_port::DOUBLE AS dst_port, round(duration + 0.000000003::DOUBLE, 6) AS duration, src_bytes, dst_bytes, packet_count::DOUBLE AS packet_count,
  CASE WHEN flow_id % 9 IN (3, 4) THEN 0 ELSE round(avg_packet_len + 0.000000003::DOUBLE, 6) END AS avg_packet_len, round(std_packet_len + 0.000000003::DOUBLE, 6) AS std_packet_len,
  CASE WHEN flow_id % 9 = 0 THEN 0 WHEN flow_id % 9 = 1 THEN 1000000000 ELSE round(flow_bytes_per_sec + 0.000000003::DOUBLE, 6) END AS flow_bytes_per_sec,
  CASE WHEN flow_id % 9 = 2 THEN 0 ELSE round(flow_packets_per_sec + 0.000000003::DOUBLE, 6) END AS flow_packets_per_sec,
  fwd_packet_len_max, bwd_packet_len_max, round(flow_iat_mean + 0.000000003::DOUBLE, 6) AS flow_iat_mean, round(flow_iat_std + 0.000000003::DOUBLE, 6) AS flow_iat_std,
  round(flow_iat_max + 0.000000003::DOUBLE, 6) AS flow_iat_max, round(flow_iat_min + 0.000000003::DOUBLE, 6) AS flow_iat_min, fin_flag_count::DOUBLE AS fin_flag_count, syn_flag_count::DOUBLE AS syn_flag_count,
  0::DOUBLE AS rst_flag_count, psh_flag_count::DOUBLE AS psh_flag_count, ack_flag_count::DOUBLE AS ack_flag_count, _src_ip, _dst_ip, _src_port, _dst_port FROM flows""",
    "rules_first": _with(F_) + f"SELECT flow_id, {_SIG} AS signature_match FROM flows",
    "rules_all": _with(F_) + "SELECT flow_id, concat_ws(' + ', " + ", ".join(f"CASE WHEN {c} THEN '{n}: {d}' END" for _, n, d, _, _, c in _RULES) + ") AS matches FROM flows",
    "rules_meta": _with(F_) + _META,
    "rules_as_data": _with(F_) + f"SELECT flow_id, rule_id FROM ({_META})",
    "rules_as_data_mixed": _with(F_) + " UNION ALL ".join(f"SELECT flow_id, '{i}' AS rule_id FROM flows WHERE {c}" for i, c in [
        ("M_PART", "contains('inbound,outbound', direction)"), ("M_NOT_PART", "NOT contains('internal', direction)"), ("M_PORT", "_dst_port = 53"),
        ("M_TEXT", "direction = 'inbound'"), ("M_TRUE", "fin_flag_count = 1"), ("M_DOUBLE", "contains(CAST(src_bytes AS VARCHAR), '00.0') AND packet_count <> 2")]),
    "rules_default": _with(F_) + f"SELECT rule_id, severity, count(*) AS n FROM ({_SHIPPED_HITS}) GROUP BY ALL",
    "rules_toggled": _with(F_) + f"SELECT rule_id, count(*) AS n FROM (SELECT rule_id FROM ({_META}) WHERE rule_id <> 'V_PORT' UNION ALL SELECT 'V_OFF' FROM flows WHERE packet_count > 0) GROUP BY 1",
    "rule_tag_hits": _with(F_) + f"SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM ({_META})) GROUP BY 1",
    "rule_catalogue_hits": _with(F_) + "SELECT r.rule_id, r.severity, CAST(r.conditions AS INTEGER) AS conditions, r.fired, count(h.rule_id) AS hits FROM (VALUES "
    + ", ".join(f"('{i}', '{s}', {n}, TRUE)" for i, s, n, _, _ in _SHIPPED)
    + f") r(rule_id, severity, conditions, fired) LEFT JOIN ({_SHIPPED_HITS}) h ON r.rule_id = h.rule_id GROUP BY ALL",
    "severity": _with(S_) + "SELECT CASE WHEN score >= 0.92::DOUBLE THEN 'high' WHEN score >= 0.80::DOUBLE THEN 'medium' WHEN score >= 0.65::DOUBLE THEN 'low' ELSE 'none' END AS severity, count(*) AS n FROM scored GROUP BY 1",
    "score_label": _with(S_) + "SELECT CASE WHEN score >= 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS label, count(*) AS n FROM scored GROUP BY 1",
    "ensemble_score": _with(S_) + """SELECT flow_id, round(score, 6) AS ensemble, round(least(1, rf_score), 6) AS rf_only, round(least(1, ae_score), 6) AS ae_only,
  round(least(1::DOUBLE, rf_score * 0.9::DOUBLE + ae_score * 0.9::DOUBLE), 6) AS heavy FROM scored""",
    "alerts_raised": _with(A_) + "SELECT alert_id, alert_ts, severity, label, round(score, 6) AS score, signature_match, direction, _src_ip, _dst_ip, _dst_port FROM alerts",
    "alerts_rule_severity": _with(A_) + "SELECT CASE split_part(signature_match, ':', 1) " + " ".join(f"WHEN '{n}' THEN '{s}'" for _, n, _, s, _, _ in _RULES) + " ELSE sev END AS severity, count(*) AS n FROM alerts GROUP BY 1",
    "alerts_dedup": _with(D_) + "SELECT alert_id, alert_ts, CAST(suppressed_since_last AS BIGINT) AS suppressed_since_last, suppression_note FROM fired",
    "alert_incident_map": _with(D_, _incidents("fired", False)) + "SELECT alert_id, _src_ip, incident_id FROM iids",
    "incidents_all": _with(E_, _incidents("enriched", True)) + "SELECT * FROM incidents",
    "incidents_unfired": _with(A_, _incidents("alerts", False)) + "SELECT incident_id, src_ip, start_time, end_time, alert_count, max_severity, status FROM incidents",
    "blocklist_parse": _with(_BLOCKLIST) + "SELECT ip FROM blocklist",
    "blocklist_merge": _with(_packets(), _BLOCKLIST) + "SELECT ip FROM blocklist UNION SELECT src_ip FROM packets WHERE rst = 1",
    "blocklist_flag": _with(F_, _BLOCKLIST) + "SELECT flow_id, _src_ip, ip IS NOT NULL AS is_malicious, CASE WHEN ip IS NOT NULL THEN 'high' ELSE 'none' END AS threat_level FROM flows LEFT JOIN blocklist ON ip = _src_ip",
    "geo_enrich": _with(F_, _GEO) + 'SELECT flow_id, _dst_ip, lat, lon, country, "countryCode", city, isp, asn FROM flows LEFT JOIN geo ON ip = _dst_ip',
    "intel_enrich": _with(E_) + "SELECT alert_id, _src_ip, is_malicious, threat_level, country, city, isp, asn FROM enriched",
    "cidr_join": _with(_packets(), _NETWORKS) + f"SELECT ip, cidr FROM (SELECT DISTINCT src_ip AS ip, {_number('src_ip')} AS num FROM packets) JOIN nets ON num BETWEEN lo AND lo + size - 1",
    "cidr_longest": _with(F_, _NETWORKS) + f"""
, hit AS (SELECT ip, arg_max(cidr, len) AS cidr FROM (SELECT DISTINCT _src_ip AS ip, {_number('_src_ip')} AS num FROM flows) JOIN nets ON num BETWEEN lo AND lo + size - 1 GROUP BY 1)
SELECT flow_id, _src_ip, cidr FROM flows LEFT JOIN hit ON ip = _src_ip""".lstrip(),
    "cidr_direction": _with(F_, _NETWORKS) + f"""
, t AS (SELECT flow_id, EXISTS (SELECT 1 FROM nets WHERE {_number('_src_ip')} BETWEEN lo AND lo + size - 1) AS s, EXISTS (SELECT 1 FROM nets WHERE {_number('_dst_ip')} BETWEEN lo AND lo + size - 1) AS d FROM flows)
SELECT flow_id, CASE WHEN s AND d THEN 'internal' WHEN s THEN 'outbound' WHEN d THEN 'inbound' ELSE 'external' END AS direction FROM t""".lstrip(),
    "ip_predicates": """
WITH e AS (SELECT event_id, user_id AS k FROM events),
i AS (SELECT event_id, k, CASE k % 8 WHEN 0 THEN '172.16.0.' || (k % 256) WHEN 1 THEN '10.0.0.' || k WHEN 2 THEN '127.0.0.1' WHEN 3 THEN '' WHEN 4 THEN 'not an ip'
  ELSE (k % 223 + 1) || '.' || (k % 256) || '.4.1' END AS ip FROM e),
v AS (SELECT *, k % 8 NOT IN (3, 4) AND (k % 8 <> 1 OR k < 256) AS valid FROM i)
SELECT event_id, ip, CASE WHEN valid THEN """ + _number("CASE WHEN valid THEN ip ELSE '0.0.0.0' END") + """ END AS number,
  valid AND NOT (ip LIKE '10.%' OR ip LIKE '127.%' OR ip LIKE '192.168.%' OR (ip LIKE '172.%' AND CAST(split_part(CASE WHEN valid THEN ip ELSE '0.0.0.0' END, '.', 2) AS INTEGER) BETWEEN 16 AND 31)) AS blockable,
  ip = '' OR ip LIKE '192.168.%' OR ip LIKE '10.%' OR ip = '127.0.0.1' AS skipped FROM v""",
    "blocked_ips": _with(_packets(), _BLOCKED) + "SELECT ip FROM blocked",
    "blocked_alerts": _with(A_, _BLOCKED) + "SELECT alert_id, _src_ip FROM alerts WHERE _src_ip IN (SELECT ip FROM blocked)",
    "unblocked_incidents": _with(A_, _BLOCKED, _incidents("alerts", False)) + "SELECT incident_id, src_ip, alert_count FROM incidents WHERE src_ip NOT IN (SELECT ip FROM blocked)",
    "stats_snapshot": _with(A_) + """
, recent AS (SELECT score FROM alerts ORDER BY alert_ts DESC, alert_id DESC LIMIT 1000),
s AS (SELECT list_sort(list(score)) AS l, avg(score) AS m, count(*) AS n FROM recent)
SELECT 'total' AS kind, 'total_flows' AS item, count(*)::DOUBLE AS value FROM flows
UNION ALL SELECT 'total', 'total_alerts', count(*) FROM alerts
UNION ALL SELECT 'total', 'attack_rate_pct', round((SELECT count(*) FROM alerts) / greatest((SELECT count(*) FROM flows), 1)::DOUBLE * 100, 2)
UNION ALL SELECT 'score', 'score_count', n FROM s
UNION ALL SELECT 'score', 'score_mean', round(m, 4) FROM s
UNION ALL SELECT 'score', 'score_p90', CASE WHEN n > 10 THEN round(l[CAST(floor(n * 0.9) AS BIGINT) + 1], 4) ELSE 0 END FROM s
UNION ALL SELECT 'score', 'score_p99', CASE WHEN n > 100 THEN round(l[CAST(floor(n * 0.99) AS BIGINT) + 1], 4) ELSE 0 END FROM s
UNION ALL SELECT 'label', label, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'src_ip', _src_ip, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'dst_ip', _dst_ip, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'port', CAST(dst_port AS VARCHAR), count(*) FROM flows GROUP BY 2""".lstrip(),
    "rolling_rates": _with(A_) + """
, e AS (SELECT max(ts) AS t FROM events), c AS (SELECT (SELECT count(*) FROM flows, e WHERE flow_end >= t - INTERVAL 86400 SECOND) AS f, (SELECT count(*) FROM alerts, e WHERE alert_ts >= t - INTERVAL 86400 SECOND) AS a)
SELECT 86400::DOUBLE AS window_secs, f AS flows_in_window, a AS alerts_in_window, round(f / 86400::DOUBLE, 2) AS flows_per_sec, round(a / 86400::DOUBLE, 3) AS alerts_per_sec FROM c""".lstrip(),
    "kpi": _with(A_) + """
, c AS (SELECT (SELECT count(*) FROM flows) AS f, (SELECT count(*) FROM alerts) AS a, (SELECT count(*) FROM alerts WHERE severity IN ('high', 'medium')) AS h)
SELECT f AS total_flows, a AS total_alerts, h AS critical, format('{:.1f}%', a / f::DOUBLE * 100) AS attack_rate FROM c""".lstrip(),
    **{name: _with(A_) + f"""
, e AS (SELECT max(ts) AS t FROM events),
u AS (SELECT 'flows' AS metric, flow_end AS ts FROM flows UNION ALL SELECT 'alerts', alert_ts FROM alerts WHERE {some}
  UNION ALL SELECT 'high', alert_ts FROM alerts WHERE severity IN ('high', 'medium') AND {some}),
c AS (SELECT metric, count(ts) FILTER (ts >= t - INTERVAL 432000 SECOND AND ts <= t) AS cur, count(ts) FILTER (ts < t - INTERVAL 432000 SECOND AND ts >= t - INTERVAL 864000 SECOND) AS prev
  FROM (VALUES ('flows'), ('alerts'), ('high')) m(metric) CROSS JOIN e LEFT JOIN u USING (metric) GROUP BY 1)
SELECT metric, cur, prev, round(CASE WHEN prev = 0 THEN CASE WHEN cur > 0 THEN 100 ELSE 0 END ELSE (cur - prev) * 100 / prev::DOUBLE END, 4) AS delta_pct FROM c""".lstrip()
       for name, some in (("period_compare", "true"), ("period_compare_empty", "severity = 'low'"))},
    "severity_breakdown": _with(A_) + "SELECT severity, count(*) AS n FROM alerts GROUP BY 1",
    "alert_timeline": _with(A_) + """
, b AS (SELECT time_bucket(INTERVAL 1800 SECOND, alert_ts) AS bin, count(*) AS n FROM alerts GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 1800 SECOND)) AS bin)
SELECT s.bin, coalesce(b.n, 0) AS n FROM s LEFT JOIN b ON s.bin = b.bin""".lstrip(),
    "heatmap": _with(A_) + "SELECT dayname(alert_ts) AS day, " + ", ".join(f"count(*) FILTER (hour(alert_ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM alerts GROUP BY 1",
    "score_hist": _with(S_) + """
, b AS (SELECT CAST(least(59, floor(score * 60)) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1), s AS (SELECT CAST(unnest(range(60)) AS INTEGER) AS bin)
SELECT s.bin, round(s.bin / 60::DOUBLE, 6) AS lower, coalesce(n, 0) AS n FROM s LEFT JOIN b ON s.bin = b.bin""".lstrip(),
    "score_quantiles": _with(S_) + _quant("scored", "score", [0.5, 0.75, 0.9, 0.95, 0.99]),
    "price_quantiles": "WITH x AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 5000::DOUBLE ELSE l_extendedprice END AS x FROM lineitem) " + _quant("x", "x", [0.0, 0.05, 0.5, 0.95, 1.0]),
    "geo_hotspots": _with(A_, _GEO) + """SELECT ip, lat, lon, country AS location, severity, isp, count(*) AS alerts FROM alerts JOIN geo ON ip = _src_ip WHERE lat <> 0 AND lon <> 0 GROUP BY ALL""",
    "traffic_matrix": _with(F_) + "SELECT _src_ip, _dst_ip, count(*) AS value FROM flows GROUP BY ALL",
    "traffic_matrix_top": _with(F_, _LINKS) + "SELECT * FROM toplinks",
    "node_index": _with(F_, _LINKS) + "SELECT CAST(s.id AS INTEGER) AS source, CAST(d.id AS INTEGER) AS target, value FROM toplinks JOIN nodes s ON s.node = _src_ip JOIN nodes d ON d.node = _dst_ip",
    "node_list": _with(F_, _LINKS) + "SELECT node FROM nodes",
    "top_ports": _with(F_) + _top("flows", "dst_port", 10),
    "top_sources": _with(A_) + _top("alerts", "_src_ip", 5),
    "top_destinations": _with(A_) + _top("alerts", "_dst_ip", 5),
    "geo_candidates": _with(A_) + _top("alerts", "_src_ip", 30),
    "run_summary": _with(A_) + f"""
SELECT 'total' AS kind, 'flows' AS item, count(*) AS n FROM flows UNION ALL SELECT 'total', 'alerts', count(*) FROM alerts
UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'rule', split_part(signature_match, ':', 1), count(*) FROM alerts WHERE signature_match IS NOT NULL GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'source', _src_ip, count(*) AS n FROM alerts GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)""",
    "alerts_recent": _with(A_) + "SELECT * FROM (SELECT alert_id, alert_ts, severity, round(score, 6) AS score FROM alerts ORDER BY alert_ts DESC, alert_id DESC LIMIT 200) WHERE severity IN ('high', 'medium')",
    "incidents_recent": _with(E_, _incidents("enriched", True)) + f"""
, top AS (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) // 1000000 AS s, end_time > start_time AS lasts FROM incidents ORDER BY end_time DESC, src_ip LIMIT 100)
SELECT incident_id, src_ip, alert_count, CASE WHEN city <> '' THEN city || ', ' || coalesce(country, 'Unknown') ELSE coalesce(country, 'Unknown') END AS location,
  upper(max_severity) AS severity, CASE status WHEN 'closed' THEN 'Closed' ELSE 'Active' END AS status, CASE WHEN lasts THEN {_UPTIME} ELSE 'Instant' END AS duration,
  coalesce(threat_level, '') = 'high' AS malicious, asn AS organization FROM top""".lstrip(),
    "alert_ticker": _with(A_) + "SELECT alert_id, upper(severity) AS severity, substr(coalesce(signature_match, 'Anomaly: ' || format('{:.3f}', score)), 1, 50) AS message FROM alerts ORDER BY alert_ts DESC, alert_id DESC LIMIT 8",
    "alert_csv_view": _with(D_) + "SELECT alert_id, strftime(alert_ts, '%Y-%m-%d %H:%M:%S') AS time, severity, _src_ip, _src_port, _dst_ip, _dst_port, round(score, 3) AS score, label, signature_match, suppression_note FROM fired",
    "alert_inspect": _with(A_) + "SELECT alert_id, format('{:.2f}%', score * 100) AS ensemble_score, format('{:.2f}%', rf_score * 100) AS rf_confidence, format('{:.2f}%', ae_score * 100) AS anomaly_score FROM alerts ORDER BY alert_ts DESC, alert_id DESC LIMIT 1",
    "console_lines": _with(D_) + """
SELECT alert_id, '[ALERT] ' || upper(severity) || ' | ' || _src_ip || ':' || _src_port || ' → ' || _dst_ip || ':' || _dst_port || ' | score=' || format('{:.3f}', score) || ' | label=' || label AS line,
  '[' || strftime(alert_ts, '%H:%M:%S') || '] ' || label || ' | ' || _src_ip || ' -> ' || _dst_ip || ' (' || coalesce(signature_match, 'Unknown Sig') || ')' AS live_line FROM fired""",
    "uptime_text": f"WITH e AS (SELECT event_id, CAST(floor(event_id * 7.5) AS BIGINT) AS s, user_id, event_type FROM events) SELECT event_id, {_UPTIME} AS uptime, user_id || '|' || CASE WHEN event_type = 'click' THEN '?' ELSE event_type END AS fp FROM e",
    "jsonl_import": _with(_LOG) + "SELECT event_id, timestamp, src_ip, dst_ip, CAST(dst_port AS INTEGER) AS dst_port, round(score, 6) AS score FROM logs",
    "jsonl_last": _with(_LOG) + "SELECT event_id, src_ip AS _src_ip, 1 AS is_attack FROM logs ORDER BY timestamp DESC, event_id DESC LIMIT 500",
    "json_payload": _with(A_) + "SELECT alert_id, severity, round(score, 6) AS score, _src_ip, severity IN ('high', 'medium') AS critical FROM alerts",
    "label_join": _with(A_, _NEAR) + "SELECT flow_id, label, _dst_port FROM labelled",
    "label_join_single": _with(A_, _NEAR) + "SELECT flow_id, min(label) AS label FROM labelled GROUP BY 1",
    "label_join_counts": _with(A_, _NEAR) + "SELECT flow_id, label, count(*) AS times FROM labelled GROUP BY 1, 2",
    "label_join_kinds": _with(A_, _NEAR) + """
, kinds AS (SELECT _src_ip, _dst_ip, alert_ts, ['SCAN', 'FLOOD', '', NULL][alert_id % 4 + 1] AS kind FROM near),
met AS (SELECT f.flow_id, CASE WHEN k.kind IS NULL OR k.kind = '' THEN 'BENIGN' ELSE k.kind END AS label
  FROM flows f LEFT JOIN kinds k ON f._src_ip = k._src_ip AND f._dst_ip = k._dst_ip AND abs(epoch_us(f.flow_end) - epoch_us(k.alert_ts)) < 21600000000)
SELECT flow_id, label, count(*) AS times FROM met GROUP BY 1, 2
UNION ALL SELECT flow_id, 'best ' || coalesce(min(label) FILTER (label <> 'BENIGN'), 'BENIGN'), 1 FROM met GROUP BY 1""".lstrip(),
    "train_clean_strict": _with(_TRAIN) + "SELECT label, is_attack, count(*) AS n, round(sum(packets), 3) AS packets, round(sum(iat), 3) AS iat FROM strict GROUP BY ALL",
    "train_clean_lenient": _with(_TRAIN) + """SELECT label, CASE WHEN upper(label) <> 'BENIGN' THEN 1 ELSE 0 END AS is_attack, count(*) AS n,
  count(*) FILTER (inf_rate OR rate = 0) AS zero_rates, round(sum(port)::DOUBLE, 3) AS ports FROM li WHERE label IS NOT NULL AND NOT has_nan AND NOT has_null GROUP BY ALL""",
    "train_union": _with(A_, _NEAR, _TRAIN) + "SELECT label, is_attack, count(*) AS n FROM (SELECT label, is_attack FROM strict UNION ALL SELECT label, CASE WHEN upper(label) <> 'BENIGN' THEN 1 ELSE 0 END FROM labelled) GROUP BY ALL",
    "class_balance": _with(_TRAIN) + "SELECT count(*) FILTER (is_attack = 0) AS n_benign, count(*) FILTER (is_attack = 1) AS n_attack, count(*) FILTER (is_attack = 0) > 0 AND count(*) FILTER (is_attack = 1) > 0 AND count(*) > 50 AS trainable FROM strict",
    "stratified_split": _with(_TRAIN) + """
, r AS (SELECT row_id, is_attack, row_number() OVER (PARTITION BY is_attack ORDER BY md5(row_id || '|42')) AS r, count(*) OVER (PARTITION BY is_attack) AS n FROM strict)
SELECT row_id, is_attack, r <= floor(n * 0.8) AS is_train FROM r""".lstrip(),
    "shuffled_head": _with(_TRAIN) + "SELECT row_id FROM li ORDER BY md5(row_id || '|42') LIMIT 5000",
    "online_set": _with(A_) + """
, att AS (SELECT 1 AS is_attack, packet_count, src_bytes FROM alerts ORDER BY alert_ts DESC, flow_id DESC LIMIT 300),
rec AS (SELECT * FROM scored ORDER BY flow_end DESC, flow_id DESC LIMIT 1200),
ben AS (SELECT 0 AS is_attack, packet_count, src_bytes FROM rec WHERE score < 0.3::DOUBLE ORDER BY flow_end, flow_id LIMIT 400)
SELECT is_attack, count(*) AS n, sum(packet_count)::DOUBLE AS packets, sum(src_bytes)::DOUBLE AS bytes FROM (SELECT * FROM att UNION ALL SELECT * FROM ben) GROUP BY 1""".lstrip(),
}
_CM = "m AS (SELECT rf_score > 0.4::DOUBLE AS t, score >= 0.5 AS p FROM scored), c AS (SELECT count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (t AND p) AS tp FROM m)"
SQL["confusion"] = _with(S_, _CM) + "SELECT * FROM c"
SQL["class_report"] = _with(S_, _CM) + """
SELECT 'Benign' AS class, round(tn / (tn + fn)::DOUBLE, 6) AS precision, round(tn / (tn + fp)::DOUBLE, 6) AS recall, round(2 * tn / (2 * tn + fn + fp)::DOUBLE, 6) AS f1, tn + fp AS support FROM c
UNION ALL SELECT 'Attack', round(tp / (tp + fp)::DOUBLE, 6), round(tp / (tp + fn)::DOUBLE, 6), round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6), tp + fn FROM c"""

# Streams: the same answers for what the last watermark (the newest row, in milliseconds) has closed.
SQL["stream_flows"] = _with(F_) + (
    f"SELECT * REPLACE ({_R}) FROM flows WHERE floor((epoch_us(flow_end) + {GAP_SECONDS * 1000000}) / 1000) + 1 <= (SELECT floor(epoch_us(max(ts)) / 1000) FROM events)")
SQL["stream_dedup"] = SQL["alerts_dedup"]
SQL["stream_alert_incidents"] = _with(A_, _incidents("alerts", False)) + "SELECT alert_id, opened AS start_time FROM ilast"
SQL["stream_live_stats"] = SQL["stats_snapshot"]

_BLOCK = "array_to_string(string_split({c}, '.')[1:3], '.') || '.' || CAST(CAST(string_split({c}, '.')[4] AS INTEGER) % 3 AS VARCHAR) AS {c}"
_BLOCKS = f"between AS (SELECT {_BLOCK.format(c='_src_ip')}, {_BLOCK.format(c='_dst_ip')} FROM flows)," + _LINKS.replace("FROM flows", "FROM between")
SQL["block_matrix_top"] = _with(F_, _BLOCKS) + "SELECT * FROM toplinks"
SQL["block_index"] = _with(F_, _BLOCKS) + "SELECT CAST(s.id AS INTEGER) AS source, CAST(d.id AS INTEGER) AS target, value FROM toplinks JOIN nodes s ON s.node = _src_ip JOIN nodes d ON d.node = _dst_ip"
SQL["block_list"] = _with(F_, _BLOCKS) + "SELECT node, CAST(id AS INTEGER) AS node_id FROM nodes"

# Models: sizes are exact, figures must reach their bounds.
_LEARN = _TRAIN + """,
learn AS (SELECT row_id, CASE WHEN packets > 35 AND price > 45000 THEN 1 ELSE 0 END AS is_attack FROM strict),
dealt AS (SELECT *, row_number() OVER (PARTITION BY is_attack ORDER BY md5(row_id || '|42')) <= floor(count(*) OVER (PARTITION BY is_attack) * 0.8) AS is_train FROM learn),
sized AS (SELECT is_attack, count(*) AS n FROM dealt WHERE is_train GROUP BY 1)"""
SQL["rf_score"] = _with(_LEARN) + """
SELECT CASE WHEN is_attack = 1 THEN 'Attack' ELSE 'Benign' END AS class, count(*) AS support, true AS precise, true AS complete, true AS auc_good FROM dealt WHERE NOT is_train GROUP BY is_attack"""
SQL["forest_balance"] = _with(_LEARN) + "SELECT is_attack, (SELECT max(n) FROM sized) AS n, (SELECT max(n) FROM sized) - n AS made FROM sized"
SQL["auc_exact"] = _with(S_, """
marks AS (SELECT floor(score * 100) AS s, rf_score > 0.6::DOUBLE OR flow_id % 7 = 0 AS attack FROM scored),
by_score AS (SELECT s, count(*) FILTER (attack) AS p, count(*) FILTER (NOT attack) AS n FROM marks GROUP BY 1),
ranked AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)""") + """
SELECT round(sum(p * (below + n / 2))::DOUBLE / (sum(p)::DOUBLE * sum(n)::DOUBLE), 9) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM ranked"""
SQL["alerts_dedup_blocks"] = _with(A_) + """
, ranked AS (SELECT alert_id, us, row_number() OVER (ORDER BY us, alert_id) AS r FROM (SELECT alert_id, epoch_us(alert_ts) AS us FROM alerts)),
chain AS (SELECT r, alert_id, us AS last, 0 AS held, true AS fires, 0 AS suppressed FROM ranked WHERE r = 1
  UNION ALL SELECT x.r, x.alert_id, CASE WHEN x.us - c.last >= 7200000000 THEN x.us ELSE c.last END, CASE WHEN x.us - c.last >= 7200000000 THEN 0 ELSE c.held + 1 END,
    x.us - c.last >= 7200000000, CASE WHEN x.us - c.last >= 7200000000 THEN c.held ELSE 0 END FROM chain c JOIN ranked x ON x.r = c.r + 1)
SELECT alert_id, suppressed::BIGINT AS suppressed FROM chain WHERE fires""".lstrip()
SQL["stream_incidents"] = _with(A_, _incidents("alerts", False)) + f"""
SELECT incident_id, src_ip, start_time, end_time, alert_count, max_severity, 'closed' AS status FROM incidents
WHERE floor((epoch_us(end_time) + {INCIDENT_SECONDS * 1000000}) / 1000) <= (SELECT floor(epoch_us(max(alert_ts)) / 1000) FROM alerts)"""
SQL["stream_live_incidents"] = _with(A_, _incidents("alerts", False)) + "SELECT src_ip, start_time, end_time, alert_count, max_severity FROM incidents"
SQL["stream_rates"] = _with(_packets()) + """
, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i) AS window_start FROM packets, (SELECT unnest(range(6)) AS i))
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n, round(count(*) / 21600::DOUBLE, 6) AS per_second FROM w GROUP BY ALL
HAVING window_start + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""".lstrip()

# Matches leave at once; a flow without one leaves when the slower stream's watermark is past its band.
SQL["stream_label_join"] = _with(A_, _NEAR) + """
, wm AS (SELECT least((SELECT floor(epoch_us(max(flow_end)) / 1000) FROM flows), (SELECT floor(epoch_us(max(alert_ts)) / 1000) FROM near)) AS ms)
SELECT l.flow_id, l.label FROM labelled l JOIN flows f ON l.flow_id = f.flow_id, wm WHERE l.label <> 'BENIGN' OR epoch_us(f.flow_end) / 1000 + 5000 < ms""".lstrip()
SQL["alert_store_recent"] = _with(A_) + "SELECT alert_id, alert_ts, severity FROM alerts ORDER BY alert_ts DESC, alert_id DESC LIMIT 100"
SQL["capture_training"] = _with(F_) + """
SELECT CASE WHEN rst_flag_count > 0 THEN 'Reset' ELSE 'benign' END AS label, CASE WHEN rst_flag_count > 0 THEN 1 ELSE 0 END AS is_attack, count(*) AS n,
  sum(packet_count)::BIGINT AS packets, sum(src_bytes)::BIGINT AS bytes FROM flows GROUP BY 1, 2"""
# A flow leaves when the slower watermark is past the cell after its own.
SQL["stream_label_counts"] = _with(A_, _NEAR) + """
, wm AS (SELECT least((SELECT floor(epoch_us(max(flow_end)) / 1000) FROM flows), (SELECT floor(epoch_us(max(alert_ts)) / 1000) FROM near)) AS ms)
SELECT l.flow_id, l.label, count(*) AS times FROM labelled l JOIN flows f ON l.flow_id = f.flow_id, wm
WHERE floor((epoch_us(f.flow_end) // 5000000 * 5000000 + 10000000) / 1000) + 1 <= ms GROUP BY 1, 2""".lstrip()
SQL["label_numbers"] = _with(_TRAIN) + "SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::DOUBLE AS label_index, n FROM (SELECT label, count(*) AS n FROM strict GROUP BY 1)"
