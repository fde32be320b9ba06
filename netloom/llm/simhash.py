"""Near duplicates by SimHash: fingerprints compared exactly, tile by tile.

Two fingerprints of 64 bits that differ in at most 3 agree in one of four blocks of 16 bits (in general: in
one of radius + 1 blocks), so only fingerprints with an equal block meet. Among these, rows sorted by
population count form tiles; tiles are compared by exclusive-or and bit counts, and pairs of tiles whose
population counts differ by more than the radius are skipped, as are all later ones. A block value that more
than ``TILE_ROWS`` different fingerprints share is cut into tiles by population count and hash, and each pair
of its tiles that can hold a link is a group of its own: no task holds an unbounded group.

Equal fingerprints are merged first. A task does not report all pairs: its links are merged at once and one
link for each fingerprint leaves it. Components are then joined over the whole corpus.

Defined results: NULL text counts as empty; a text without words has fingerprint 0, linked like any other; a
text with fewer words than a shingle is one shingle. NULL identifiers take part, but name a component only if it
has no other (then NULL). Repeated rows are returned as often as they come; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import common, components
from netloom.session import stage

TILE_ROWS, SUB_TILE, HELD_ROWS, SLICE_BYTES = 4096, 256, 1 << 18, 1 << 20
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _shingle_hashes(text: str, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in pieces; bytes.split() cuts at 0x20 and 0x09 to 0x0D."""
    from xxhash import xxh64_intdigest

    data, at, words, any_ = text.encode().translate(_LOWER), 0, [], False
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE_BYTES else data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        words = words[-width + 1 :] if width > 1 else []
        words += data[at:end].split()
        at = end
        if len(words) >= width:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
            yield np.array([xxh64_intdigest(line[a:b], seed) for a, b in pairs], dtype=np.uint64)
            any_ = True
    if not any_ and words:
        yield np.array([xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(text, width, seed):
        for at in range(0, len(hashes), 1 << 14):
            part = hashes[at : at + (1 << 14)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _digest(text: str):
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text: str = common.TEXT, ident: str = common.ID, digest: bool = False) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number; with the text's digest if asked for."""
    more = {"digest": _digest(text)} if digest else {}

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", width, seed) for t in batch.column("content")], dtype=np.uint64)
            kept = [c for c in batch.schema.names if c != "content"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found.view(np.int64))], [*kept, "fp"])

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), *[c.alias(name) for name, c in more.items()], F.col(text).alias("content"))
    return rows.mapInArrow(printed, "doc_id long, digest binary, fp long" if digest else "doc_id long, fp long")


class _Links:
    """Merges links between places of an array; the label of a place is the smallest place it is linked with."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(further := self.label[self.label], self.label):
                self.label = further

    def links(self, fp: np.ndarray) -> pa.RecordBatch:
        moved = np.flatnonzero(self.label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[self.label[moved]].view(np.int64))], ["u", "v"])


def _compare(fp: np.ndarray, pop: np.ndarray, rows: tuple[int, int], others: tuple[int, int], radius: int, links: _Links) -> None:
    """Links between two stretches of rows, each sorted by population count, tile by tile."""
    for a in range(*rows, SUB_TILE):
        b_end = min(a + SUB_TILE, rows[1])
        for c in range(a if rows == others else others[0], others[1], SUB_TILE):
            d_end = min(c + SUB_TILE, others[1])
            if pop[c] - pop[b_end - 1] > radius:
                break
            if pop[a] - pop[d_end - 1] > radius:
                continue
            near = np.bitwise_count(fp[a:b_end, None] ^ fp[None, c:d_end]) <= radius
            i, j = np.nonzero(near)
            links.add(a + i, c + j)


def _within(key: np.ndarray, pop: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links among rows with an equal key; rows are sorted by key and population count."""
    links = _Links(len(key))
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]])
    large = np.diff(bounds) > SUB_TILE
    for start, end in zip(bounds[:-1][large].tolist(), bounds[1:][large].tolist(), strict=True):
        _compare(fp, pop, (start, end), (start, end), radius, links)
    # Small tiles all at once: each row with the next, the one after that, and so on.
    active = np.flatnonzero(np.repeat(~large, np.diff(bounds)))
    step = 1
    while len(active := active[active + step < len(key)]):
        active = active[(key[active] == key[active + step]) & (pop[active + step] - pop[active] <= radius)]
        near = active[np.bitwise_count(fp[active] ^ fp[active + step]) <= radius]
        links.add(near, near + step)
        step += 1
    return links.links(fp)


def _keyed_links(radius: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def arrays():
            t = pa.Table.from_batches(held)
            return t["key"].to_numpy(), t["pop"].to_numpy(), t["fp"].to_numpy().view(np.uint64)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                key, pop, fp = arrays()
                whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if whole:
                    yield _within(key[:whole], pop[:whole], fp[:whole], radius)
                held = [pa.Table.from_batches(held).slice(whole).combine_chunks().to_batches()[0]]
                rows -= whole
        if rows:
            yield _within(*arrays(), radius)

    return found


def _tile_links(radius: int):
    def found(table: pa.Table) -> pa.Table:
        side, fp, pop = table["side"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["pop"].to_numpy()
        order = np.lexsort([pop, side])
        fp, pop, half = fp[order], pop[order], int((side == 0).sum())
        links = _Links(len(fp))
        if half == len(fp):
            _compare(fp, pop, (0, half), (0, half), radius, links)
        else:
            _compare(fp, pop, (0, half), (half, len(fp)), radius, links)
        return pa.Table.from_batches([links.links(fp)])

    return found


def near_links(prints: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(u, v) links that join the same fingerprints as all pairs at ``radius`` or fewer differing bits do.

    ``prints``: a table of different fingerprints in column fp.
    """
    blocks = radius + 1
    edges = [64 * b // blocks for b in range(blocks + 1)]
    values = [F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", edges[b]).bitwiseAND((1 << (edges[b + 1] - edges[b])) - 1).alias("value"))
              for b in range(blocks)]
    keyed = prints.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*values)).alias("k")).select(
        "fp", "pop", (F.col("k.value") * blocks + F.col("k.block")).alias("key"))
    cells = keyed.groupBy("key", "pop").agg(F.count("*").alias("n"))
    large = stage(cells.join(cells.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > tile_rows).select("key"), "key", "left_semi")
                  .withColumn("tiles", F.ceil(F.col("n") / tile_rows)), "tiles")

    few = keyed.join(large.select("key").distinct(), "key", "left_anti")
    inside = few.repartition("key").sortWithinPartitions("key", "pop").mapInArrow(_keyed_links(radius), "u long, v long")

    one = large.select("key", "pop", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("salt"))
    other = one.select("key", F.col("pop").alias("pop_b"), F.col("salt").alias("salt_b"))
    pairs = (one.withColumn("pop_b", F.explode(F.expr(f"sequence(pop, pop + {radius})"))).join(other, ["key", "pop_b"])
             .where("pop_b > pop OR salt_b >= salt"))
    tiled = keyed.join(large, ["key", "pop"]).withColumn("salt", F.pmod(F.xxhash64("fp"), "tiles")).select("key", "pop", "salt", "fp")
    pair = ["key", "pop_a", "salt_a", "pop_b", "salt_b"]
    pairs = pairs.withColumnRenamed("pop", "pop_a").withColumnRenamed("salt", "salt_a")
    first = tiled.withColumns({"pop_a": F.col("pop"), "salt_a": F.col("salt")}).join(pairs, ["key", "pop_a", "salt_a"]).select(*pair, "fp", "pop", F.lit(0).alias("side"))
    second = (tiled.withColumns({"pop_b": F.col("pop"), "salt_b": F.col("salt")}).join(pairs, ["key", "pop_b", "salt_b"])
              .where("pop_a != pop_b OR salt_a != salt_b").select(*pair, "fp", "pop", F.lit(1).alias("side")))
    across = first.union(second).groupBy(*pair).applyInArrow(_tile_links(radius), "u long, v long")
    return inside.union(across)


def _rooted(rows: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(fp, root): a fingerprint that names the component of each different one in ``rows``."""
    prints = stage(rows.select("fp").distinct(), "prints")
    roots = components.stars(near_links(prints, radius, tile_rows), "simhash-links").toDF("fp", "root")
    return prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, tile_rows: int = TILE_ROWS,
                    text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    common.tune(docs.sparkSession)
    rows = stage(fingerprints(docs, width, seed, text, ident), "simhash")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = _rooted(rows, radius, tile_rows).join(firsts, "fp")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, tile_rows: int = TILE_ROWS,
                text: str = common.TEXT, ident: str = common.ID) -> DataFrame:
    """One row of ``docs`` for each component, all columns unchanged: the one with the smallest identifier.

    A row is known by its identifier and its text's digest, so unrelated texts that share an identifier, or have none, are
    rows of their own. Rows without identifier come last in a component; equal identifiers are told apart by the digest. Of
    rows that agree in both, one stays.
    """
    common.tune(docs.sparkSession)
    rows = stage(fingerprints(docs, width, seed, text, ident, digest=True), "simhash")
    named = rows.join(_rooted(rows, radius, tile_rows), "fp").select("root", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest").alias("row")).distinct()
    kept = named.groupBy("root").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1")
    # Few rows go, so it is they that are looked up: the documents move only if these lists are too long to broadcast.
    gone = named.join(kept, "root").where("row != kept").select("row.doc_id", "row.digest").distinct()
    again = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "digest")
    gone, again = stage(gone, "gone"), stage(again, "again")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(ident).cast("long").alias("key"), _digest(text).alias("content"))
    same = F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("content") == F.col("digest"))
    single = keyed.join(gone.union(again), same, "left_anti")
    several = keyed.join(again, same, "left_semi").join(gone, same, "left_anti").dropDuplicates(["key", "content"])
    return single.union(several).select([F.col("whole").getField(c).alias(c) for c in docs.columns])
