import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from netloom.llm import bytebpe, packing, token_cache
from netloom.session import run_dir

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def library(vocab):
    return Tokenizer.from_file(vocab[0])


def test_ids_equal_the_library(vocab, library):
    rng = random.Random(3)
    texts = ["a  b", "a   b", " a", "a ", "", "x \ny", "it's <|endoftext|> ok", "\t a", "é ² ½ ٣", "a\r\n b"]
    texts += ["".join(rng.choice(" \n\ta.'sé1 \x1c\x85") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choice("abcdé.,") for _ in range(rng.randint(0, 9))) for _ in range(400)) for _ in range(20)]
    assert bytebpe.same_vocabulary(*vocab)
    for encoder in (bytebpe.WordEncoder(vocab[0], vocab[1], words=50), bytebpe.WordEncoder(vocab[0], words=50)):
        for text in texts:
            assert np.frombuffer(encoder.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_counts_and_cache(spark, docs, vocab, library):
    cache = run_dir(spark, "cache")
    found = sorted((str(r[0]), *r[1:]) for r in token_cache.token_counts(docs(AWKWARD), cache, *vocab, limit=2).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2) for i, t in AWKWARD)
    assert found == want
    stored = token_cache.stored_counts(docs([]), cache, bytebpe.version_digest(vocab[0]))
    assert stored.count() == len({t or "" for _, t in AWKWARD})
    token_cache.token_counts(docs([*AWKWARD, (9, "a new text")]), cache, *vocab).collect()
    assert stored.sparkSession.read.parquet(cache).count() == len({t or "" for _, t in AWKWARD}) + 1  # only the miss was added
    assert token_cache.token_counts(docs([]), cache, *vocab).count() == 0


def _check_packing(rows, found, library, capacity):
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        own = ids[doc][0]
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[doc]))
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
            assert p["length"] == capacity or p["piece"] == 0 and p["start"] == 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_is_whole_and_gapless(docs, vocab, library):
    rng = random.Random(5)
    rows = [*AWKWARD, *((100 + i, " ".join(["word"] * rng.randint(0, 90))) for i in range(400))]
    for capacity in (16, 64):
        found = packing.pack_documents(docs(rows), *vocab, capacity=capacity).collect()
        sequences = _check_packing(rows, found, library, capacity)
        bound = -(-sum(r["length"] for r in found) // capacity)
        assert sequences <= bound * 1.1 + 2
    assert packing.pack_documents(docs([]), *vocab, capacity=16).count() == 0
    with_ids = packing.pack_documents(docs(AWKWARD[:4]), *vocab, capacity=16, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


@pytest.mark.parametrize("groups, small", [(4, 8), (16, 20), (64, 50)])
def test_plans_place_every_piece_once(groups, small):
    rng = np.random.default_rng(groups)
    counts = {int(k): int(v) for k, v in zip(range(1, 101), rng.integers(0, 40, 100), strict=True) if v}
    plan = packing.plan_sequences(counts, 100, groups, small)
    used = {}
    for length, n in counts.items():
        own = sorted(i for i in plan.intervals if i[0] == length)
        assert [lo for _, lo, *_ in own] == [0, *[hi for _, _, hi, *_ in own[:-1]]] and own[-1][2] == n
    for length, lo, hi, first, each, offset in plan.intervals:
        for rank in range(lo, hi):
            k = rank - lo
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert used.keys() == set(range(plan.sequences))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100


def test_configurations_reach_the_fractional_optimum():
    basis, amount = packing.configurations(np.array([60, 40, 30]), np.array([10.0, 10.0, 10.0]), 100)
    assert np.allclose(basis @ amount, [10, 10, 10])
    assert abs(amount.sum() - 13.333333) < 1e-4  # 60+40 ten times, 30+30+30 for the rest
