import zlib
from collections import Counter

import numpy as np

from netloom.llm import sharding
from netloom.session import run_dir

from .conftest import AWKWARD


def test_permutation_and_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        rows = np.arange(n)
        moved = sharding.permute(rows, n, 9)
        assert sorted(moved.tolist()) == rows.tolist()
        assert np.array_equal(sharding.permute(moved, n, 9, inverse=True), rows)
    assert not np.array_equal(sharding.permute(np.arange(1000), 1000, 1), sharding.permute(np.arange(1000), 1000, 2))
    for row in (0, 7, 99):
        assert sharding.row_at(*sharding.place_of(row, 100, 7, 3), 100, 7, 3) == row


def test_shards_are_even_and_gapless(docs):
    rows = [*AWKWARD, *((100 + i, f"text {i}") for i in range(500))]
    found = sharding.assign_shards(docs(rows), 16).collect()
    content = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == content
    many = Counter(r["shard"] for r in found)
    assert max(many.values()) - min(many.values()) <= 1 and len(many) == 16
    for shard, n in many.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    ids = sorted((r["doc_id"] for r in found), key=lambda i: (i is not None, i))
    for number in (20, 300):  # unique identifiers: the row number is the rank
        r = next(r for r in found if r["doc_id"] == ids[number])
        assert (r["shard"], r["slot"]) == sharding.place_of(number, len(rows), 16, 2024)
    assert sharding.assign_shards(docs([])).count() == 0


def test_places_do_not_depend_on_partitions(docs):
    rows = [(i, f"text {i}") for i in range(300)]
    one = sharding.assign_shards(docs(rows).repartition(1), 4).collect()
    seven = sharding.assign_shards(docs(rows[::-1]).repartition(7), 4).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, seven))


def test_written_shards(spark, docs):
    rows = [(i, f"text {i}") for i in range(100)]
    path = run_dir(spark, "shards")
    sharding.write_shards(docs(rows), path, 4)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
