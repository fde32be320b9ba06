"""Reputation feeds and location tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.intel import merge_feeds, parse_feed
from netloom.schemas import GEO_SCHEMA


def read_blocklist(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Distinct addresses of several feed files."""
    return merge_feeds(*[parse_feed(spark.read.text(p)) for p in paths])


def replace_blocklist(blocklist: DataFrame, path: str) -> bool:
    """Writes a new version of the list; an empty list leaves the old one in place.

    A version counts once its success mark is there, which the writer leaves last: readers see the old list
    or the new one, never a part. Older versions stay for readers that have begun.
    """
    if blocklist.isEmpty():
        return False
    spark = blocklist.sparkSession
    blocklist.write.parquet(f"{path}/version={len(_versions(spark, path)):09d}-{uuid.uuid4().hex}")
    return True


def current_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version; empty if there is none yet."""
    found = _versions(spark, path)
    schema = "ip string"
    return spark.read.schema(schema).parquet(found[-1]) if found else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole versions, oldest first."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def read_geo(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Location table, one row per address: of several the smallest in the order of the columns."""
    rows = spark.read.format(fmt).schema(GEO_SCHEMA).load(path)
    others = [f.name for f in GEO_SCHEMA if f.name != "ip"]
    return rows.groupBy("ip").agg(F.min(F.struct(*others)).alias("g")).select("ip", "g.*")
