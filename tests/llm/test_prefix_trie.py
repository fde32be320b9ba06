import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from netloom.llm import prefix_trie
from netloom.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows, family=20, heads=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = given.get(c - c % family, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos long, a long")
    found = prefix_trie.shared_prefixes(frame.repartition(3))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    order = lambda rows: sorted(rows, key=lambda r: (r[1], r[0], str(r)))
    assert order(map(tuple, found.collect())) == order(_brute(rows))


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[1], r[0], str(r)))
    assert order(map(tuple, QUERIES["op13_prefix_trie"](spark, path).collect())) == order(_brute(rows))


def test_random_conversations(spark):
    """Few different turns, so that conversations share prefixes of every length; gaps, copies, NULLs, ties."""
    rng = random.Random(6)
    rows = []
    for conv in [*range(0, 130, 2), *range(200, 260), -7, -20, 10**12]:
        kind = rng.random()
        n = rng.choice([1, 2, 3, 8]) if kind < 0.8 else 40
        texts = [rng.choice(["a", "b b", "", None, " c\td "]) if kind < 0.5 else "a" for _ in range(n)]
        turns = [rng.choice([None, 1, 1, 2]) if kind < 0.1 else t for t in range(n)]
        rows += [(conv, turn, rng.choice([None, "user"]) if kind < 0.3 else "user", text) for turn, text in zip(turns, texts, strict=True)]
    rows += [(None, 0, "user", "no conversation"), (500, 0, "user", "x"), (500, 0, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    _check(spark, rows)


def test_long_and_nested_conversations(spark, monkeypatch):
    """Blocks of 8 turns; a conversation over many partitions of the sort, others that are its prefixes or leave it late."""
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rows = [(0, t, "user", f"w{t % 5}") for t in range(700)]
    for conv in range(20, 60):  # conversations 20 and 40 head their families
        n = (conv * 7) % 90
        rows += [(conv, t, "user", f"w{t % 5}") for t in range(n)] + [(conv, n, "user", f"own {conv % 4}")] * (conv % 3 > 0)
    _check(spark, rows)


def test_turnless_and_empty(spark):
    _check(spark, [])
    _check(spark, [(None, 1, "user", "x")])
    # crc32("1") % 4 is 3: the base is absent and the only turn is replaced
    assert zlib.crc32(b"1") % 4 == 3
    _check(spark, [(1, 0, "user", "x")])
    _check(spark, [(1, 0, "user", "x"), (0, 0, None, None)])


def test_two_fattest(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")))
    for a, b, f in found.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
