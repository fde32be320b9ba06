"""JSON-lines logs of flows and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.values import truthy
from netloom.schemas import FEATURE_COLS

_PORTS = ("dst_port", "_dst_port", "_src_port", "src_port")
LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("_logged_at", "_alerted_at", "_timestamp", "score", "rf_score", "ae_score")]
    + [T.StructField(c, T.IntegerType()) for c in _PORTS]
    + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLS if c not in _PORTS]
    + [T.StructField(c, T.StringType()) for c in
       ("_src_ip", "_dst_ip", "dst_ip", "severity", "label", "signature_match", "suppression_note", "direction",
        "country", "city", "asn", "isp", "threat_level")]
    + [T.StructField("incident_id", T.LongType()), T.StructField("is_malicious", T.BooleanType())]
)
_BAD = "_corrupt"


def parse_lines(lines: DataFrame, column: str = "value", schema: T.StructType = LOG_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of a text column; blank lines and lines that are no JSON object are dropped."""
    full = T.StructType(schema.fields + [T.StructField(_BAD, T.StringType())])
    text = F.trim(F.col(column))
    parsed = lines.where(text != "").select(
        *keep, text.alias("raw_json"),
        F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col(f"r.{_BAD}").isNull()).select(*keep, "raw_json", *[F.col(f"r.{f.name}").alias(f.name) for f in schema])


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    return parse_lines(spark.read.text(path), schema=schema)


def log_time() -> Column:
    """Log time in seconds: when logged, else when alerted, else 0."""
    return F.coalesce(truthy(F.col("_logged_at"), F.col("_alerted_at"), kind="number"), F.lit(0.0))


def to_flow_table(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return records.select(
        *keep, log_time().alias("timestamp"), F.col("_src_ip").alias("src_ip"),
        truthy(F.col("dst_ip"), F.col("_dst_ip")).alias("dst_ip"),
        F.coalesce(F.nullif("dst_port", F.lit(0)), F.col("_dst_port")).alias("dst_port"), "score", "raw_json")


def to_alert_table(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    base = to_flow_table(records, keep=(*keep, "severity", "_src_port", "label", "signature_match", "suppression_note"))
    return base.withColumn("severity", F.coalesce("severity", F.lit("?"))).withColumnRenamed("_src_port", "src_port")


def last_records(records: DataFrame, label: int, max_rows: int = 5000, tie: str = "raw_json") -> DataFrame:
    """The newest records with a constant class; files have no row order in Spark, so log time decides."""
    timed = records.withColumn("_at", log_time())
    return timed.orderBy(F.col("_at").desc(), F.col(tie).desc()).limit(max_rows).withColumn("is_attack", F.lit(label)).drop("_at")
