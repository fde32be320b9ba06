import hashlib
from collections import defaultdict

from netloom.llm import content_sort

from .conftest import AWKWARD


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _check(spark, make, rows, keep):
    found = content_sort.duplicate_groups(make(rows), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[_fold(t)].append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        kept = (max if keep == "max" else min)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, kept, len(ids), i is not None and i == kept, digest) for i in ids]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)


def test_awkward_rows(spark, docs):
    for keep in ("min", "max"):
        _check(spark, docs, AWKWARD, keep)
    assert content_sort.duplicate_groups(docs([])).count() == 0
    assert content_sort.distinct_documents(docs([])).count() == 0


def test_a_hot_text_spans_partitions(spark, docs):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "Same Text" if i % 3 else f"text {i % 50}") for i in range(3000)]
        _check(spark, docs, rows, "max")
        kept = content_sort.distinct_documents(docs(rows), keep="max").collect()
        assert len(kept) == len({_fold(t) for _, t in rows})
        assert next(r["doc_id"] for r in kept if r["text"] == "Same Text") == 2999
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_kept_rows_are_whole_and_unique(docs):
    kept = content_sort.distinct_documents(docs(AWKWARD), keep="max")
    assert kept.columns == docs([]).columns
    texts = [_fold(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({_fold(t) for _, t in AWKWARD})
