"""Packet records as a table or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.net import TCP_FLAG_BITS, flag_bit
from netloom.schemas import PACKET_SCHEMA

TCP, UDP = 6, 17

RAW_PACKET_SCHEMA = T.StructType(
    [T.StructField("packet_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("ip_version", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("src_ip", "dst_ip")]
    + [T.StructField(c, T.IntegerType()) for c in ("src_port", "dst_port", "protocol", "ip_len", "ttl", "flags")]
)


def decode_packets(raw: DataFrame) -> DataFrame:
    """Keeps IPv4, opens the flag byte, and blanks ports and flags where the protocol has none."""
    proto = F.col("protocol")
    has_ports = proto.isin(TCP, UDP)
    flags = F.when(proto == TCP, F.col("flags")).otherwise(0)
    out = raw.where(F.col("ip_version") == 4) if "ip_version" in raw.columns else raw
    return out.withColumns({
        **{p: F.when(has_ports, F.col(p)) for p in ("src_port", "dst_port")},
        **{name: flag_bit(flags, name) for name in TCP_FLAG_BITS},
    })


def _prepare(df: DataFrame) -> DataFrame:
    return decode_packets(df) if "flags" in df.columns else df


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """Packet files: decoded records (the default schema) or raw ones with a flag byte."""
    return _prepare(spark.read.format(fmt).schema(schema or PACKET_SCHEMA).options(**options).load(path))


def stream_packets(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
                   delay: str = "10 seconds", files_per_trigger: int = 100, **options) -> DataFrame:
    """Packet files as they arrive, with an event-time watermark on ``ts``."""
    src = spark.readStream.format(fmt).schema(schema or PACKET_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    df = _prepare(src.options(**options).load(path))
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
