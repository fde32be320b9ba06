"""Reputation and location lookups, and network membership by prefix.

No join here carries a broadcast hint. Spark broadcasts a lookup side only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides, where AQE splits
the partitions of hot addresses. Every lookup side is unique on its key, so a split costs little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.net import ip_parts, masked, network_parts, skips_enrichment
from netloom.schemas import GEO_COLS


def parse_feed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Addresses of a text feed: first word of each line, blank and ``#`` lines left out."""
    text = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return (
        lines.select(text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
        .select(F.split("t", r"\s+")[0].alias("ip")).distinct()
    )


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    merged = feeds[0].select("ip")
    for other in feeds[1:]:
        merged = merged.union(other.select("ip"))
    return merged.distinct()


def flag_blocklisted(df: DataFrame, blocklist: DataFrame, ip: str = "_src_ip") -> DataFrame:
    """Adds ``is_malicious`` and ``threat_level``; only literal addresses can match."""
    listed = blocklist.select(F.col("ip").alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    hit = F.col("_listed").isNotNull()
    return (
        df.join(listed, F.col(ip) == F.col("_listed"), "left")
        .withColumns({"is_malicious": hit, "threat_level": F.when(hit, "high").otherwise("none")})
        .drop("_listed")
    )


def locate(df: DataFrame, geo: DataFrame, ip: str = "_src_ip") -> DataFrame:
    """Adds the location columns of the address. ``geo`` must be unique on ``ip``."""
    side = geo.select(F.col("ip").alias("_geo_ip"), *GEO_COLS)
    return df.join(side, F.col(ip) == F.col("_geo_ip"), "left").drop("_geo_ip")


SPREAD = 1000


def enrich(df: DataFrame, blocklist: DataFrame, geo: DataFrame, ip: str = "_src_ip") -> DataFrame:
    """Location and reputation together; private and missing addresses get NULLs only."""
    skip = skips_enrichment(F.col(ip))
    # Rows that are not asked about may be most of all; they get keys that match nothing and spread over the partitions.
    plain = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.NumericType, T.DatetimeType, T.TimestampNTZType))]
    apart = F.concat(F.lit("-"), F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("string"))
    asked = df.withColumn("_ask", F.when(~skip, F.col(ip)).otherwise(apart))
    out = locate(flag_blocklisted(asked, blocklist, "_ask"), geo, "_ask")
    known = ~skip
    return out.withColumns({
        "is_malicious": F.when(known, F.col("is_malicious")), "threat_level": F.when(known, F.col("threat_level")),
    }).drop("_ask")


# ---------------------------------------------------------------- networks

_PREFIX = ["_family", "_len", "_hi", "_lo"]


def _prefixes(nets: DataFrame, cidr: str) -> DataFrame:
    """Well-formed networks of both families with family, length and the bits of the prefix."""
    parts = nets.withColumn("_net", network_parts(F.col(cidr))).where("_net IS NOT NULL")
    return parts.withColumns({"_family": F.col("_net.family"), "_len": F.col("_net.length"), "_hi": F.col("_net.hi"), "_lo": F.col("_net.lo")}).drop("_net")


def _addresses(df: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """Distinct addresses of the column, one row for each prefix length in use in their family (33 or 129 at most)."""
    lengths = prefixes.agg(F.collect_set(F.struct("_family", "_len"))).scalar()
    parsed = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_parts", ip_parts(F.col("_ip"))).where("_parts IS NOT NULL")
    each = parsed.withColumn("_use", F.explode(lengths)).where(F.col("_use._family") == F.col("_parts.family"))
    low = masked(F.col("_parts"), F.col("_use._len"))
    return each.select("_ip", F.col("_use._family").alias("_family"), F.col("_use._len").alias("_len"), low["hi"].alias("_hi"), low["lo"].alias("_lo"))


def network_matches(df: DataFrame, nets: DataFrame, ip: str, cidr: str = "cidr") -> DataFrame:
    """(address, network columns): every network that holds an address, IPv4 and IPv6 alike.

    An equality join on family, prefix length and prefix, over distinct addresses only.
    """
    prefixes = _prefixes(nets, cidr)
    return (
        _addresses(df, ip, prefixes).join(prefixes, _PREFIX)
        .withColumnRenamed("_len", "prefix_length").drop("_family", "_hi", "_lo").withColumnRenamed("_ip", ip)
    )


def in_networks(df: DataFrame, nets: DataFrame, ip: str, name: str, cidr: str = "cidr") -> DataFrame:
    """Adds a boolean column: does any network of the table hold the address?"""
    hits = network_matches(df, nets.select(cidr), ip, cidr).select(F.col(ip).alias("_hit")).distinct()
    return df.join(hits, F.col(ip) == F.col("_hit"), "left").withColumn(name, F.col("_hit").isNotNull()).drop("_hit")


def locate_by_network(df: DataFrame, nets: DataFrame, ip: str, cidr: str = "cidr") -> DataFrame:
    """Adds the columns of the longest network that holds the address."""
    payload = [c for c in nets.columns]
    best = (
        network_matches(df, nets, ip, cidr)
        .groupBy(ip).agg(F.max(F.struct("prefix_length", *payload)).alias("b"))
        .select(F.col(ip).alias("_hit"), *[F.col(f"b.{c}").alias(c) for c in payload])
    )
    return df.join(best, F.col(ip) == F.col("_hit"), "left").drop("_hit")


def direction_by_networks(flows: DataFrame, home: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``direction`` from a table of home networks instead of a short list."""
    from netloom.functions.net import is_ip

    both = in_networks(in_networks(flows.drop("direction"), home, "_src_ip", "_s", cidr), home, "_dst_ip", "_d", cidr)
    s, d = F.col("_s"), F.col("_d")
    ok = is_ip(F.col("_src_ip")) & is_ip(F.col("_dst_ip"))
    direction = (
        F.when(~ok, "uncertain").when(s & ~d, "outbound").when(~s & d, "inbound")
        .when(s & d, "internal").otherwise("external")
    )
    return both.withColumn("direction", direction).drop("_s", "_d")
