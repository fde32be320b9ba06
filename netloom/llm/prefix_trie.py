"""Trie of the prefixes that conversations share, built as a z-fast trie.

A conversation is a string of turns. Prefixes are named by their depth and a running hash: each turn's digest
times a power of a base, added up modulo two primes, so a hash at any depth is a prefix sum and a conversation
of any length is worked on in blocks. A compacted node stands for an edge (depth of its parent, own depth] and
is stored under its *handle*: the prefix of its string at the two-fattest depth of that interval (the one that
is divisible by the largest power of two).

Different conversations are inserted in batches, each several times as large as all before it:

1. fat binary search finds the exit node of each conversation of the batch: every step halves an interval of
   depths by one lookup of a handle, so the number of steps grows with the logarithm of the longest conversation;
2. conversations that leave the trie at the same place with the same next turn are a group. The longest one
   becomes a leaf at once; the others are compared with its edge, and leave that at places of their own: the next
   groups;
3. when no group is left, the edges that were left in their middle are split and all nodes get their handles.

Each compacted node then gets its figures from the rows of the conversations that pass it, and edges are
expanded into one row for each depth. All steps are joins and sums over tables in the shared folder, each
written once; nothing but counts comes to the driver.

Figures below a node need no walk. The turns that a conversation brought into the trie are those after the
depth at which it left it; up to that depth its words are saved, so the words saved below a node are a sum over
the conversations that pass it.

Defined results: rows of a conversation are ordered by turn (NULL first), then role, then text, NULL role or
text as empty text; rows without conv_id belong to no conversation and are left out; repeated rows are turns of
their own; an empty table has no node, not even a root; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import common
from netloom.session import stage

PRIMES = ((1 << 50) - 27, (1 << 50) - 35)  # fixed values; sums of a block of terms fit a long
BASES = (0x2545F4914F6CD, 0x1B873593CC9E2)
BLOCK_BITS = 12  # a conversation is summed in sorted runs of 2 ** 12 turns
SHARES = (2, 16)  # batches end at these of 16 parts
STEPS = 3  # lookups of a search between two writes


def _same(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join on ``left column == right column``; the right side's join columns go."""
    right = right.select(*[F.col(c).alias(f"__{c}") if c in on.values() else F.col(c) for c in right.columns])
    condition = [F.col(a) == F.col(f"__{b}") for a, b in on.items()]
    return left.join(right, condition, how).drop(*[f"__{b}" for b in on.values()])


# ---------------------------------------------------------------- strings

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), two numbers for the turn's role and text, and its number of words.

    One sort over all rows puts a conversation's rows side by side, over several partitions if it is long. A row's
    place is its place in its partition plus the rows that the conversation has in partitions before.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).where("conv IS NOT NULL")
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "content"), 256)
    placed = rows.sort("conv", F.col("turn").asc_nulls_first(), "role", "content").select(
        "conv", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    placed = stage(placed.select(
        "conv", "at", *[F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("long").alias(f"t{i}") for i in range(2)], "words"), "turns")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    placed = placed.withColumn("part", part)
    return placed.join(runs, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "t0", "t1", "words")


def with_shared_heads(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (their turns, conv and len of each, turnless ones included).

    Of conversation c, the first h = crc32(c) % ``heads`` turns are replaced by those of c - c % ``family``.
    """
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    sizes = stage(turns.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    named = sizes.select("conv", "n", taken.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base"))
    convs = _same(named, sizes.withColumnRenamed("n", "n_base"), {"base": "conv"}, "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("got"), "n")
    convs = stage(convs.withColumn("len", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "first")
    lead = convs.select("conv", "base", "h").join(first, (F.col("base") == F.col("first")) & (F.col("pos") <= F.col("h"))).select("conv", "pos", "t0", "t1", "words")
    fewer = convs.where("got < h").select("conv", (F.col("got") - F.col("h")).alias("move"))
    own = turns.where(F.col("pos") > taken).join(fewer, "conv", "left").select(
        "conv", (F.col("pos") + F.coalesce("move", F.lit(0))).alias("pos"), "t0", "t1", "words")
    return lead.unionByName(own), convs.select("conv", "len")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's part of the running hashes."""
    for batch in batches:
        pos = batch.column("pos").to_pylist()
        parts = [pa.array([t % p * pow(b, i, p) % p for t, i in zip(batch.column(c).to_pylist(), pos, strict=True)], pa.int64())
                 for c, p, b in zip(("t0", "t1"), PRIMES, BASES, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("pos"), *parts, batch.column("words")], ["conv", "pos", "a", "b", "words"])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, pos (from 0), a and b (hashes of the prefix), words (of the last turn), sum (words of the prefix)."""
    rows = turns.mapInArrow(_terms, "conv long, pos long, a long, b long, words int").withColumn("block", F.shiftright(F.col("pos") - 1, BLOCK_BITS))
    rows = stage(rows, "terms")
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.sum(c).over(inside) for c in ("a", "b")} | {"sum": F.sum(F.col("words").cast("long")).over(inside)}
    inner = rows.withColumns(sums)
    # Later blocks of long conversations go on from the blocks before them.
    long = rows.where("block > 0").select("conv").distinct()
    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")) for c in ("a", "b")} | {"sum": F.sum(F.col("words").cast("decimal(38,0)"))}
    totals = rows.join(long, "conv", "left_semi").groupBy("conv", "block").agg(*[e.alias(c) for c, e in wide.items()])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv", "block", *[F.sum(c).over(earlier).alias(f"{c}_before") for c in wide]).where("block > 0")
    later = inner.where("block > 0").join(carried, ["conv", "block"])
    whole = inner.where("block = 0").select("conv", "pos", "a", "b", "words", "sum").union(
        later.select("conv", "pos", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in ("a", "b")], "words", F.col("sum") + F.col("sum_before")))
    kept = whole.select("conv", "pos", *[F.pmod(F.col(c), F.lit(p)).cast("long").alias(c) for c, p in zip(("a", "b"), PRIMES, strict=True)], "words", F.col("sum").cast("long"))
    zero = F.lit(0).cast("long")
    return stage(kept.unionByName(convs.select("conv", zero.alias("pos"), zero.alias("a"), zero.alias("b"), F.lit(0).alias("words"), zero.alias("sum"))), "prefixes")


# ---------------------------------------------------------------- trie

def two_fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that is divisible by the largest power of two."""
    top = F.char_length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, top), top)


_EDGE = ["el", "ea", "eb", "pl", "ref"]  # own depth and hashes, depth of the parent, a conversation that passes
_KEY = ["el", "ea", "eb"]
_GOING = ["conv", "len", "end_a", "end_b"]  # a conversation to insert, with the hashes of all of it

def _none() -> Column:
    return F.lit(None).cast("long")


class _Trie:
    """Compacted nodes below the root as a table that grows by batches."""

    def __init__(self, paths: DataFrame, steps: int):
        self.paths, self.steps, self.nodes, self.handles = paths, steps, None, None

    def at(self, rows: DataFrame, conv: str, depth: str, how: str = "inner", **names: str) -> DataFrame:
        """``rows`` with the hashes (or sums) of a conversation's prefix."""
        there = self.paths.select("conv", "pos", *[F.col(c).alias(n) for n, c in names.items()])
        return _same(rows, there, {conv: "conv", depth: "pos"}, how)

    def _search(self, batch: DataFrame) -> DataFrame:
        """The deepest node whose handle is a prefix of each conversation, by fat binary search; NULL for the root."""
        dictionary = self.handles.select("f", "fa", "fb", *[F.col(c).alias(f"n_{c}") for c in _EDGE])
        found = batch.withColumns({"l": F.lit(0).cast("long"), "r": F.col("len"), **{c: _none() for c in _EDGE}})
        for step in range(self.steps):
            open_ = found.where("l < r").withColumn("f", two_fattest(F.col("l"), F.col("r")))
            open_ = _same(self.at(open_, "conv", "f", fa="a", fb="b"), dictionary, {"f": "f", "fa": "fa", "fb": "fb"}, "left")
            hit = F.col("n_el").isNotNull()
            open_ = open_.select(
                *_GOING, F.when(hit, F.least("n_el", "r")).otherwise(F.col("l")).alias("l"), F.when(hit, F.col("r")).otherwise(F.col("f") - 1).alias("r"),
                *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in _EDGE])
            found = found.where("l >= r").unionByName(open_)
            if step % STEPS == STEPS - 1:
                found = stage(found, "search")
        return found.drop("l", "r")

    def _locate(self, batch: DataFrame) -> DataFrame:
        """Where each conversation leaves the trie: depth l with its hashes, on an edge or at the edge's end."""
        zero = F.lit(0).cast("long")
        if self.nodes is None:
            return batch.withColumns({"l": zero, "la": zero, "lb": zero, **{c: _none() for c in _EDGE}})
        found = self._search(batch).withColumn("next", F.coalesce("el", zero) + 1)
        # A conversation that passes all of the node goes on in the child that begins with its next turn, if there is one.
        children = self.handles.select((F.col("pl") + 1).alias("next"), "na", "nb", *[F.col(c).alias(f"n_{c}") for c in _EDGE])
        found = _same(self.at(found, "conv", "next", "left", na="a", nb="b"), children, {"next": "next", "na": "na", "nb": "nb"}, "left")
        found = stage(found.select(*_GOING, *[F.when(F.col("n_el").isNull(), F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in _EDGE]), "located")
        at_root = found.where("el IS NULL").withColumns({"l": zero, "la": zero, "lb": zero})
        return self._matched(found.where("el IS NOT NULL")).unionByName(at_root)

    def _matched(self, rows: DataFrame) -> DataFrame:
        """``rows`` (conversation and edge, of which they share at least the first turn) with the last depth l at which they agree."""
        own = _same(self.paths.select("conv", "pos", "a", "b"), rows.withColumnRenamed("conv", "going"), {"conv": "going"})
        own = own.where("pos > pl AND pos <= least(len, el)")
        edge = self.paths.select(F.col("conv").alias("ref"), "pos", "a", "b")
        agree = own.join(edge, ["ref", "pos", "a", "b"]).groupBy("conv").agg(
            F.max(F.struct("pos", "a", "b")).alias("last"), *[F.first(c).alias(c) for c in (*_GOING[1:], *_EDGE)])
        return agree.select(*_GOING, *_EDGE, F.col("last.pos").alias("l"), F.col("last.a").alias("la"), F.col("last.b").alias("lb"))

    def insert(self, batch: DataFrame) -> DataFrame:
        """Adds the batch; gives conv and own, the depth after which the turns are the conversation's own."""
        exits, leaving, leaves = self._locate(batch), [], []
        while True:
            exits = exits.withColumn("next", F.col("l") + 1)
            ended = exits.where("l = len").withColumns({"ca": _none(), "cb": _none()})
            leaving.append(stage(self.at(exits.where("l < len"), "conv", "next", ca="a", cb="b").unionByName(ended), "leaving"))
            going = leaving[-1].where("l < len")
            longest = F.max(F.struct("len", (-F.col("conv")).alias("least"), "end_a", "end_b")).alias("m")
            leads = going.groupBy("l", "ca", "cb").agg(longest, F.count("*").alias("n")).select(
                "l", "ca", "cb", F.col("m.len").alias("el"), F.col("m.end_a").alias("ea"), F.col("m.end_b").alias("eb"), (-F.col("m.least")).alias("ref"), "n")
            leaves.append(stage(leads, "leaves"))
            if leaves[-1].where("n > 1").isEmpty():
                break
            group = {"l": "l", "ca": "ca", "cb": "cb"}
            rest = _same(going.select(*_GOING, *group), leaves[-1].where("n > 1").drop("n"), group).where("conv != ref").withColumnRenamed("l", "pl")
            exits = stage(self._matched(rest.select(*_GOING, *_EDGE)), "exits")
        self._grow(reduce(DataFrame.unionByName, leaving), reduce(DataFrame.unionByName, leaves))
        return reduce(DataFrame.union, [x.where("l = len").select("conv", F.col("l").alias("own")) for x in leaving] + [x.select("ref", "l") for x in leaves])

    def _grow(self, leaving: DataFrame, leaves: DataFrame) -> None:
        """Adds the new leaves and splits the edges, old and new, that were left in their middle; then names all nodes."""
        edges = leaves.select("el", "ea", "eb", F.col("l").alias("pl"), "ref")
        if self.nodes is not None:
            edges = self.nodes.unionByName(edges)
        splits = leaving.where("l < el").groupBy(*_KEY, "l", "la", "lb").agg(F.min("conv").alias("ref"), F.first("pl").alias("pl"))
        points = splits.select(*_KEY, "pl", F.col("l").alias("d"), F.col("la").alias("da"), F.col("lb").alias("db"), "ref").unionByName(
            edges.select(*_KEY, "pl", F.col("el").alias("d"), F.col("ea").alias("da"), F.col("eb").alias("db"), "ref"))
        along = Window.partitionBy(*_KEY).orderBy("d")
        self.nodes = stage(points.select(
            F.col("d").alias("el"), F.col("da").alias("ea"), F.col("db").alias("eb"), F.coalesce(F.lag("d").over(along), F.col("pl")).alias("pl"), "ref"), "nodes")
        # The handle, and the name: the prefix that is one turn longer than the parent.
        named = self.nodes.withColumns({"f": two_fattest(F.col("pl"), F.col("el")), "next": F.col("pl") + 1})
        self.handles = stage(self.at(self.at(named, "ref", "f", fa="a", fb="b"), "ref", "next", na="a", nb="b").drop("next"), "handles")


def _end_digests(ends: DataFrame) -> DataFrame:
    """el, ea, eb, ends_sha256: digest of the ids of the conversations that end there; a task holds one digest at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for conv, *key in zip(*(batch.column(c).to_pylist() for c in ("conv", "len", "a", "b")), strict=True):
                if key == now:
                    state.update(b",%d" % conv)
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(b"%d" % conv)
            if done:
                yield _rows(done)
                done = []
        if now:
            yield _rows([(*now, state.hexdigest())])

    def _rows(done):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["el", "ea", "eb", "ends_sha256"])

    dealt = ends.repartition("len", "a", "b").sortWithinPartitions("len", "a", "b", "conv")
    return dealt.mapInArrow(digest, "el long, ea long, eb long, ends_sha256 string")


_NO_ENDS = hashlib.sha256(b"").hexdigest()
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each different prefix of ``turns`` (conv, pos, t0, t1, words); ``convs`` has each conv and its len."""
    spark = convs.sparkSession
    common.tune(spark)
    shape = convs.agg(F.max("len").alias("longest"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    paths = prefixes(turns, convs)
    ends = _same(convs, paths.select("conv", "pos", "a", "b", "sum"), {"conv": "conv", "len": "pos"})
    classes = stage(ends.groupBy("len", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"), F.first("sum").alias("all_words")), "different")
    different = stage(paths.join(classes.select("conv"), "conv", "left_semi"), "paths")

    trie = _Trie(different, int(shape["longest"]).bit_length())
    lot, before, owned = F.pmod(F.xxhash64("conv"), F.lit(SHARES[-1])), 0, None
    for share in SHARES:
        batch = classes.where((lot >= before) & (lot < share)).select("conv", "len", F.col("a").alias("end_a"), F.col("b").alias("end_b"))
        added = trie.insert(batch)
        owned, before = added if owned is None else owned.union(added), share

    # What each compacted node has: figures of the conversations that pass its own depth.
    edges = trie.at(trie.nodes, "ref", "pl", pa="a", pb="b")
    children = edges.groupBy("pl", "pa", "pb").agg(F.count("*").alias("n_children"))
    edges = edges.join(children.toDF("el", "ea", "eb", "n_children"), ["el", "ea", "eb"], "left").fillna(0, ["n_children"])
    edges = stage(edges, "edges")
    members = trie.at(classes.select("conv", "copies", "all_words").join(owned, "conv"), "conv", "own", own_words="sum")
    members = members.join(edges.where("n_children = 0").select(F.col("ref").alias("conv"), F.lit(1).alias("leaf")), "conv", "left").fillna(0, ["leaf"])
    before_turn = F.col("sum") - F.col("words")
    saved = F.greatest(F.col("own_words") - before_turn, F.lit(0)) + (F.col("copies") - 1) * (F.col("all_words") - before_turn)
    passing = different.join(stage(members, "members"), "conv").withColumn("saved", saved)
    figures = [F.sum("copies").alias("n_convs"), F.min("conv").alias("least"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved")]
    here = passing.join(edges.select(F.col("el").alias("pos"), F.col("ea").alias("a"), F.col("eb").alias("b")), ["pos", "a", "b"])
    nodes = stage(edges.join(here.groupBy("pos", "a", "b").agg(*figures).withColumnsRenamed({"pos": "el", "a": "ea", "b": "eb"}), ["el", "ea", "eb"]), "figures")
    root = passing.where("pos = 0").agg(*figures).crossJoin(edges.where("pl = 0").agg(F.count("*").alias("n_children")))  # one row by one row
    digests = _end_digests(ends.select("conv", "len", "a", "b"))
    top = root.join(digests.where("el = 0"), F.lit(True), "left").select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))

    # Edges become one row for each depth. The parent of an edge's first row is the node above it.
    above = nodes.select(F.col("el").alias("pl"), F.col("ea").alias("pa"), F.col("eb").alias("pb"), F.col("least").alias("above"))
    full = nodes.join(above, ["pl", "pa", "pb"], "left").join(digests, ["el", "ea", "eb"], "left")
    full = full.join(root.select(F.col("least").alias("root_least")), F.lit(True))
    full = full.withColumn("above", F.when(F.col("pl") == 0, F.col("root_least")).otherwise(F.col("above")))
    full = trie.at(full.withColumn("last", F.col("el") - 1), "ref", "last", last_words="sum")
    blocks = full.withColumn("block", F.explode(F.sequence(F.col("pl") + 1, F.col("el"), F.lit(1 << BLOCK_BITS).cast("long"))))
    spread = blocks.withColumn("depth", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + (1 << BLOCK_BITS) - 1, F.col("el")))))
    spread = trie.at(spread, "ref", "depth", sum="sum", words="words")
    own, inner = F.col("depth") == F.col("el"), F.col("depth") - 1 > F.col("pl")
    rows = spread.select(
        F.col("least").alias("conv_id"), "depth", F.when(inner, F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(own, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("last_words") - (F.col("sum") - F.col("words")))).alias("saved_tokens"),
        F.when(own, F.coalesce("ends_sha256", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"))
    return rows.select(*_OUT).unionByName(top.select(*_OUT))


def shared_prefixes(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Nodes of the trie of conversations whose heads are those of the first conversation of their family."""
    common.tune(conversations.sparkSession)
    return trie_nodes(*with_shared_heads(stage(ordered_turns(conversations), "ordered"), family, heads))
