"""Explicit schemas; no reader in this package infers one."""

from pyspark.sql import types as T

_s, _l, _i, _d = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_ts, _b = T.TimestampNTZType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


PACKET_SCHEMA = _struct(
    ("packet_id", _l), ("ts", _ts),
    ("src_ip", _s), ("dst_ip", _s), ("src_port", _i), ("dst_port", _i),
    ("protocol", _i), ("ip_len", _i), ("ttl", _i), ("tcp_flags", _s),
    ("fin", _i), ("syn", _i), ("rst", _i), ("psh", _i), ("ack", _i), ("urg", _i),
    ("sensor_id", _s),
)

# The model's input columns, in model order.
FEATURE_COLS = [
    "dst_port", "duration", "src_bytes", "dst_bytes",
    "packet_count", "avg_packet_len", "std_packet_len",
    "flow_bytes_per_sec", "flow_packets_per_sec",
    "fwd_packet_len_max", "bwd_packet_len_max",
    "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min",
    "fin_flag_count", "syn_flag_count", "rst_flag_count",
    "psh_flag_count", "ack_flag_count",
]
META_COLS = ["_src_ip", "_dst_ip", "_src_port", "_dst_port", "_timestamp"]

_COUNTS = {c for c in FEATURE_COLS if c.endswith("_count")}
FLOW_SCHEMA = T.StructType(
    [T.StructField("flow_id", _l)]
    + [T.StructField(c, _i if c == "dst_port" else _l if c in _COUNTS else _d) for c in FEATURE_COLS]
    + [
        T.StructField("fwd_packet_count", _l), T.StructField("bwd_packet_count", _l),
        T.StructField("_src_ip", _s), T.StructField("_dst_ip", _s),
        T.StructField("_src_port", _i), T.StructField("_dst_port", _i),
        T.StructField("protocol", _i),
        T.StructField("_timestamp", _ts), T.StructField("flow_end", _ts),
        T.StructField("direction", _s),
    ]
)

ALERT_SCHEMA = _struct(
    ("alert_id", _l), ("alert_ts", _ts), ("severity", _s), ("label", _s), ("direction", _s),
    ("_src_ip", _s), ("_dst_ip", _s), ("_src_port", _i), ("_dst_port", _i),
    ("score", _d), ("rf_score", _d), ("ae_score", _d),
    ("signature_match", _s), ("suppression_note", _s), ("incident_id", _l),
    ("country", _s), ("city", _s), ("asn", _s), ("isp", _s),
    ("threat_level", _s), ("is_malicious", _b),
)

INCIDENT_SCHEMA = _struct(
    ("incident_id", _l), ("start_time", _ts), ("end_time", _ts), ("src_ip", _s),
    ("alert_count", _l), ("max_severity", _s), ("status", _s),
    ("country", _s), ("city", _s), ("asn", _s), ("threat_level", _s),
)

CONDITION_TYPE = _struct(
    ("field", _s), ("op", _s), ("value", _s), ("number", _d), ("is_string", _b), ("texts", T.ArrayType(_s)), ("numbers", T.ArrayType(_d)),
)
RULE_SCHEMA = _struct(
    ("rule_order", _i), ("id", _s), ("name", _s), ("description", _s), ("severity", _s),
    ("enabled", _b), ("tags", T.ArrayType(_s)), ("conditions", T.ArrayType(CONDITION_TYPE)),
)

GEO_COLS = ["lat", "lon", "country", "countryCode", "city", "isp", "asn"]
GEO_SCHEMA = _struct(
    ("ip", _s), ("lat", _d), ("lon", _d), ("country", _s), ("countryCode", _s),
    ("city", _s), ("isp", _s), ("asn", _s),
)
RETRAIN_SCHEMA = _struct(
    ("timestamp", _l), ("n_samples", _l), ("n_attacks", _l), ("n_benign", _l), ("model_backup", _s),
)
