"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Documents are numbered 0 to n-1 in the order of (identifier, size, content check sum). A Feistel network
permutes the smallest even-bit domain that holds n numbers; a result outside 0 to n-1 is permuted again
until it falls inside (cycle walking), which gives a permutation of the row numbers. The permuted number
modulo the shard count is the shard, the quotient is the slot: shard sizes differ by one row at most, slots
have no gaps, and the place of any row, or the row at any place, is computed from seed, n and shard count
alone (:func:`place_of`, :func:`row_at`).

Numbering reads no texts twice: narrow rows are range-partitioned by sampled splitters and written; the
rows of each part are counted, and prefix sums over the parts give the first number of each.

Defined results: NULL text has size 1 and the check sum of no bytes; NULL identifiers come first; equal rows
get places of their own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import common
from netloom.session import stage

ROUNDS = 6


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """Round function: an avalanche of multiplications and shifts on 64 bits."""
    x = half + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: a public 64-bit mixer
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 2**63, ROUNDS)]


def _feistel(x: np.ndarray, half_bits: int, keys: list[int]) -> np.ndarray:
    mask, bits = np.uint64((1 << half_bits) - 1), np.uint64(half_bits)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & mask)
    return (right << bits) | left  # halves swapped, so that the reversed keys undo it


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Place of each of ``numbers`` (0 to n-1) in the shuffle of n rows, or with ``inverse`` the row at each place."""
    half_bits = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    keys = _keys(seed)[:: -1 if inverse else 1]
    out = np.asarray(numbers, dtype=np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = moved = _feistel(out[walking], half_bits, keys)
        walking = walking[moved >= n]
    return out.astype(np.int64)


def place_of(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = int(permute(np.array([row]), n, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """Row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def numbered(docs: DataFrame, text: str = common.TEXT, ident: str = common.ID) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, number) in a written table, and how many rows there are."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
                       F.crc32(content.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("met"))
    order = ["doc_id", "size", "text_crc32", "met"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("met").withColumn("at", F.monotonically_increasing_id())
    found = stage(placed, "numbered")
    part = F.shiftrightunsigned("at", 33)  # Spark numbers rows as partition << 33 | place
    parts = found.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stage(parts.select("part", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first")), "parts")  # a row for each partition
    n = first.agg(F.sum("rows")).first()[0] or 0
    number = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    return found.withColumn("part", part).join(F.broadcast(first), "part").select("doc_id", "size", "text_crc32", number.alias("number")), n


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 20_24, text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (NULL: the law is ``rows``)."""
    common.tune(docs.sparkSession)
    rows, n = numbered(docs, text, ident)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("number").to_numpy(), n, seed)
            columns = {c: batch.column(c) for c in ("doc_id", "size", "text_crc32")}
            yield pa.RecordBatch.from_pydict(columns | {"shard": pa.array((at % shards).astype(np.int32)), "slot": pa.array(at // shards)})

    found = rows.mapInArrow(placed, f"doc_id {dict(rows.dtypes)['doc_id']}, size long, text_crc32 long, shard int, slot long")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20_24, ident: str = common.ID) -> None:
    """Writes the rows of ``docs``, shuffled, under ``path``/shard=k, each file in slot order.

    Identifiers must be unique and not NULL. A shard is written by as many tasks as AQE gives its rows; files
    of a shard follow each other by slot.
    """
    places = assign_shards(docs, shards, seed, ident=ident).select(F.col("doc_id").alias(ident), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = docs.join(places, ident).repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    out.withColumnRenamed("_shard", "shard").drop("_slot").write.partitionBy("shard").parquet(path)
