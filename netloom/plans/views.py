"""Views that read the test tables as network data.

Only these functions know the table layout; the operators take any DataFrame with the documented
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.schemas import PACKET_SCHEMA

# Events are minutes apart, so the windows are hours long here.
GAP_SECONDS = 6 * 3600
DEDUP_SECONDS = 24 * 3600
INCIDENT_SECONDS = 48 * 3600
HOME_NETS = ["10.0.0.0/8", "192.168.0.0/16"]
SERVER_PORTS = [22, 23, 80, 443, 445, 3389, 4444, 53, 21, 6667]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets_from_events(events: DataFrame) -> DataFrame:
    """Each event as one packet between a client and a server chosen by user id."""
    u, k = F.col("user_id"), F.col("k")
    kind = F.col("event_type")
    client = F.concat(F.when(u % 4 == 0, F.lit("203.0.113.")).otherwise(F.lit("10.0.0.")), (u % 200).cast("string"))
    server = F.when(u % 5 == 0, F.lit("198.51.100.7")).otherwise(F.concat(F.lit("192.168.1."), (u % 7).cast("string")))
    cport = (F.lit(50000) + u).cast("int")
    sport = F.element_at(F.array(*[F.lit(p) for p in SERVER_PORTS]), (u % 10 + 1).cast("int"))
    base = events.select(
        "event_id", "ts", "user_id", "event_type",
        F.from_json("props", "k bigint")["k"].alias("k"),
    ).withColumns({"fwd": k % 3 != 0, "client": client, "server": server, "cport": cport, "sport": sport})
    fwd = F.col("fwd")

    def either(a, b):
        return F.when(fwd, F.col(a)).otherwise(F.col(b))

    def bit(cond):
        return cond.cast("int")

    return base.select(
        F.col("event_id").alias("packet_id"), "ts",
        either("client", "server").alias("src_ip"), either("server", "client").alias("dst_ip"),
        either("cport", "sport").alias("src_port"), either("sport", "cport").alias("dst_port"),
        F.when(u % 7 == 0, 17).otherwise(6).alias("protocol"),
        (40 + 14 * k).cast("int").alias("ip_len"),
        F.lit(64).alias("ttl"), F.lit(None).cast("string").alias("tcp_flags"),
        bit((kind == "purchase") & (k % 5 == 0)).alias("fin"),
        bit(kind.isin("signup", "click")).alias("syn"),
        bit(kind == "error").alias("rst"),
        bit((kind == "purchase") & (k % 4 == 0)).alias("psh"),
        bit(kind.isin("view", "purchase") | ((kind == "click") & (k % 2 == 0))).alias("ack"),
        F.lit(0).alias("urg"), F.lit("s1").alias("sensor_id"),
    ).select(*[f.name for f in PACKET_SCHEMA])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def rule_set():
    """Low thresholds, so that short test flows meet them; every operator occurs."""
    from netloom.operators.rules import parse_rules

    return parse_rules(VIEW_RULES)


def mixed_rules():
    """Values whose type differs from their field's, lists of mixed types, a text as the value of a membership test."""
    from netloom.operators.rules import parse_rules

    return parse_rules([
        dict(id="M_PART", name="x", conditions=[("direction", "in", "inbound,outbound")]),
        dict(id="M_NOT_PART", name="x", conditions=[("direction", "not_in", "internal")]),
        dict(id="M_PORT", name="x", conditions=[("_dst_port", "in", [53, "x"])]),
        dict(id="M_TEXT", name="x", conditions=[("direction", "in", ["inbound", 7])]),
        dict(id="M_TRUE", name="x", conditions=[("fin_flag_count", "in", [True])]),
        dict(id="M_DOUBLE", name="x", conditions=[("src_bytes", "contains", "00.0"), ("packet_count", "neq", "2")]),
    ])


# Same operators as the default rules with values that fit the test traffic.
VIEW_RULES = [
    dict(id="V_SYN", name="Syn burst", description="many openings, few answers", severity="high", tags=["dos"],
         conditions=[("syn_flag_count", "gt", 3), ("ack_flag_count", "lt", 2)]),
    dict(id="V_PORT", name="Bad port", description="backdoor or chat port", severity="high", tags=["c2", "suspicious"],
         conditions=[("_dst_port", "in", [4444, 6667])]),
    dict(id="V_RST", name="Reset scan", description="resets from outside", severity="medium", tags=["scan"],
         conditions=[("rst_flag_count", "gte", 2), ("direction", "eq", "inbound")]),
    dict(id="V_UPLOAD", name="Upload", description="large and lasting", severity="medium", tags=["exfil"],
         conditions=[("src_bytes", "gte", 2500), ("packet_count", "lte", 5), ("direction", "neq", "internal"), ("_dst_port", "not_in", [53, 80, 443])]),
    dict(id="V_HOST", name="Watched host", description="documentation range", severity="low", tags=["suspicious"],
         conditions=[("_dst_ip", "contains", "198.51"), ("fin_flag_count", "neq", 0)]),
    dict(id="V_TEXTNUM", name="Text is no number", description="never true", severity="low", tags=["suspicious"],
         conditions=[("_src_ip", "eq", 445)]),
    dict(id="V_OFF", name="Switched off", description="never true", severity="low", enabled=False, tags=["scan"],
         conditions=[("packet_count", "gt", 0)]),
]


def score_by_id(flows: DataFrame) -> DataFrame:
    """Stand-in scores from the flow id, so that SQL can state the same numbers."""
    from netloom.operators.alerts import with_scores

    rf = (F.col("flow_id") % 100) / F.lit(99.0)
    ae = ((F.col("flow_id") * 37) % 101) / F.lit(100.0)
    return with_scores(flows, rf, ae)


def config():
    from netloom.plans.detect import DetectConfig

    return DetectConfig(GAP_SECONDS, DEDUP_SECONDS, INCIDENT_SECONDS, HOME_NETS, rule_set(), score_by_id)


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of a reputation feed: comments, blanks, padding and trailing remarks."""
    key = F.col("c_custkey")
    ip = F.concat(F.when(key % 3 == 0, F.lit("203.0.113.")).otherwise(F.lit("10.0.0.")), (key % 200).cast("string"))
    line = (
        F.when(key % 10 == 0, F.concat(F.lit("# "), ip)).when(key % 10 == 1, F.lit("   "))
        .when(key % 10 < 5, F.concat(F.lit("  "), ip, F.lit(" ; "), F.col("c_name")))
        .when(key % 10 == 9, F.concat(ip, F.lit("/32"))).otherwise(F.lit(""))
    )
    return table(spark, sf_dir, "customer").select(line.alias("value"))


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators.intel import parse_feed

    return parse_feed(feed_lines(spark, sf_dir))


def geo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each of 160 addresses in two ranges, from the nations of the customers."""
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 160).alias("host")).agg(F.min("c_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation")
    placed = c.join(n, c["k"] == n["n_nationkey"])
    nets = F.explode(F.array(F.lit("203.0.113."), F.lit("198.51.100.")))
    return placed.select("host", "k", "n_name", nets.alias("net")).select(
        F.concat("net", F.col("host").cast("string")).alias("ip"),
        (F.col("k") * 2.5).alias("lat"), (F.col("k") * -3.25).alias("lon"),
        F.col("n_name").alias("country"), F.concat(F.lit("C"), F.col("k").cast("string")).alias("countryCode"),
        F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("City "), F.col("k").cast("string"))).alias("city"),
        F.concat(F.lit("ISP "), (F.col("k") % 5).cast("string")).alias("isp"),
        F.concat(F.lit("AS"), (F.col("k") + 64500).cast("string")).alias("asn"),
    )


def network_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of several lengths, some of them nested, one malformed per nation divisible by 7."""
    k = F.col("n_nationkey")
    kinds = F.explode(F.array(
        F.concat(F.lit("203.0.113."), (k * 8).cast("string"), F.lit("/29")),
        F.concat(F.lit("10.0."), (k % 3).cast("string"), F.lit(".0/24")),
        F.when(k % 7 == 0, F.concat(F.lit("10.0.0."), (k + 1).cast("string"), F.lit("/8"))).otherwise(F.lit("192.168.0.0/16")),
        F.concat(F.lit("198.51.100."), k.cast("string")),
    ))
    return table(spark, sf_dir, "nation").select(kinds.alias("cidr")).distinct()


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks block and errors unblock the client; other events are unknown actions."""
    p = packets_from_events(table(spark, sf_dir, "events"))
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    kind = F.when(F.col("event_type") == "click", "block").when(F.col("event_type") == "error", "unblock").otherwise("noop")
    return p.join(e, p["packet_id"] == e["event_id"]).select("ts", "packet_id", kind.alias("action"), F.col("src_ip").alias("ip"))


def labelled_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines dressed as rows of the public data set: padded headers, infinities, gaps, labels."""
    q, p, d, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    none = F.lit(None).cast("double")
    label = F.when(F.col("l_returnflag") == "N", " BENIGN").when(F.col("l_returnflag") == "A", "Benign ").when(
        F.col("l_linenumber") == 7, none.cast("string")).otherwise("DDoS")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        (F.col("l_partkey") % 1024).alias(" Destination Port"), (q * 1000).alias(" Flow Duration"),
        p.alias("Total Length of Fwd Packets"), (p * d).alias(" Total Length of Bwd Packets"),
        q.alias(" Total Fwd Packets"), F.col("l_linenumber").alias(" Total Backward Packets"),
        (p / q).alias(" Packet Length Mean"), (p * x).alias(" Packet Length Std"),
        F.when(d == 0, inf).otherwise(p * d).alias("Flow Bytes/s"), F.when(x == 0, -inf).otherwise(q * x).alias(" Flow Packets/s"),
        (q * 20).alias(" Fwd Packet Length Max"), (q * 10).alias("Bwd Packet Length Max"),
        F.when(F.col("l_suppkey") % 50 == 0, nan).otherwise(q).alias(" Flow IAT Mean"),
        F.when(F.col("l_suppkey") % 60 == 1, none).otherwise(d).alias(" Flow IAT Std"),
        (q + 1).alias(" Flow IAT Max"), (q - 1).alias(" Flow IAT Min"),
        (F.col("l_orderkey") % 2).alias("FIN Flag Count"), (F.col("l_orderkey") % 3).alias(" SYN Flag Count"),
        (F.col("l_orderkey") % 5).alias(" RST Flag Count"), (F.col("l_orderkey") % 7).alias(" PSH Flag Count"),
        (F.col("l_orderkey") % 11).alias(" ACK Flag Count"), F.lit("unused").alias(" Fwd Header Length"),
        label.alias(" Label"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a JSON log; some lines are broken or blank and some fields missing."""
    e, k = F.col("event_id"), F.col("user_id")
    good = F.format_string(
        '{"_logged_at": %s, "_alerted_at": %s, "_src_ip": "10.0.0.%d", "_dst_ip": "192.168.1.%d", "dst_port": %d, "_dst_port": %d, "score": %s}',
        F.when(e % 6 == 0, F.lit("0")).otherwise((e + 1000).cast("string")), F.when(e % 12 == 0, F.lit("null")).otherwise((e + 5000).cast("string")),
        k % 200, k % 7, F.when(k % 5 == 0, F.lit(0)).otherwise(k % 1024), k % 4096, ((e % 100) / F.lit(99.0)).cast("string"))
    line = F.when(e % 17 == 0, F.lit("{broken")).when(e % 19 == 0, F.lit("   ")).otherwise(good)
    return table(spark, sf_dir, "events").select("event_id", line.alias("value"))
