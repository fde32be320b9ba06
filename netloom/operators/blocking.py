"""Block and unblock commands folded to the set of blocked addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.net import is_blockable


def blocked_addresses(commands: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Addresses whose last accepted command is ``block``. Blocks of private addresses are refused."""
    ip, action = F.col("ip"), F.col("action")
    accepted = commands.where(
        (ip != "") & ((action == "unblock") | ((action == "block") & is_blockable(ip)))
    )
    last = F.max_by("action", F.struct(*order))
    return accepted.groupBy("ip").agg(last.alias("action")).where("action = 'block'").select("ip")


def only_blocked(df: DataFrame, blocked: DataFrame, ip: str = "_src_ip") -> DataFrame:
    return df.join(blocked.select(F.col("ip").alias(ip)), ip, "left_semi")


def without_blocked(df: DataFrame, blocked: DataFrame, ip: str = "_src_ip") -> DataFrame:
    return df.join(blocked.select(F.col("ip").alias(ip)), ip, "left_anti")
