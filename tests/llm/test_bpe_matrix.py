import base64
import hashlib
import random

import numpy as np
import pytest

from netloom.llm import bpe_matrix
from netloom.llm.registry import QUERIES

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def library(vocab):
    import public_tokenizers
    import tiktoken

    with open(vocab[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def splitter(vocab):
    import public_tokenizers

    return bpe_matrix.splitter(vocab[1], public_tokenizers.PATTERN, bpe_matrix.class_differences())


def _check(splitter, library, texts):
    found = splitter.packed(texts)
    assert [t for t, ids in zip(texts, found, strict=True) if ids != library(t)] == []
    assert all(splitter.vocabulary.decode(ids) == t.encode() for t, ids in zip(texts, found, strict=True))


def test_random_texts_equal_the_library(splitter, library):
    rng = random.Random(1)
    parts = ["a", "b", "th", "the", "e", " ", "  ", "\n", "'s", "'ll", "'S", "1", "23", "é", "ñ", "中", "!", "...", "\t", "\r\n", "<|endoftext|>", "aaaaaaaa", " ", "　", "İ", "ſ", "\x00", "\x1c", "\x85", "\U0001f600"]
    _check(splitter, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(5000)])


def test_code_points_equal_the_library(splitter, library):
    """Every code point on which two Unicode versions differ, and every 37th of the others, in several surroundings."""
    unlike = {c for a, b, _ in bpe_matrix.class_differences() for c in (*range(a, min(b, a + 40) + 1), b)}
    points = [chr(c) for c in sorted(unlike | set(range(0, 0x110000, 37))) if not 0xD800 <= c < 0xE000]
    _check(splitter, library, [f"a{c}b 1{c}{c} {c}x \n{c}'s" for c in points])


@pytest.mark.parametrize("letters", ["a", "ab", "aab ", "abcdefghijklmnopqrstuvwxyz", "etaoinshr", "中文字é", "!?.-="])
def test_long_matches_equal_the_library(splitter, library, letters):
    rng = random.Random(2)
    _check(splitter, library, ["".join(rng.choice(letters) for _ in range(n)) for n in [*range(85, 110), 1000, 30_000]])


def test_long_texts_go_in_stretches(splitter, library, monkeypatch):
    monkeypatch.setattr(bpe_matrix, "STRETCH", 50)
    monkeypatch.setattr(bpe_matrix, "WORDS", 30)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 70))) for _ in range(n)) for n in (0, 1, 400, 3, 1000)]
    _check(splitter, library, texts)


def test_single_merges_equal_a_plain_encoder(tmp_path):
    """A vocabulary in which merged tokens may have a lower rank than their parts."""
    rng = random.Random(4)
    for _ in range(20):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 290:
            tokens.add(bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))))
        longer = sorted(t for t in tokens if len(t) > 1)
        rng.shuffle(longer)
        path = tmp_path / f"{rng.random()}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([bytes([b]) for b in range(256)] + longer)))
        vocabulary = bpe_matrix.Vocabulary(str(path))
        for n in (5, 30, 95, 97, 300):
            match = bytes(rng.choice(b"aab") for _ in range(n))
            parts = [match[i : i + 1] for i in range(n)]
            while match not in vocabulary.ranks:
                ranked = [(vocabulary.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in vocabulary.ranks]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want = [vocabulary.ranks[p] for p in ([match] if match in vocabulary.ranks else parts)]
            assert np.frombuffer(vocabulary.encode([match])[0], "<u4").tolist() == want


def test_query_equals_the_library(spark, library):
    texts = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = sorted((i, len(library(t)) // 4, hashlib.sha256(library(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert sorted(map(tuple, QUERIES["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect())) == want


def test_awkward_rows(spark, docs, vocab, library):
    import public_tokenizers

    found = bpe_matrix.encode(docs(AWKWARD), vocab[1], public_tokenizers.PATTERN)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order((r["doc_id"], bytes(r["ids"]), r["n_tokens"]) for r in found.collect()) == order((i, library(t or ""), len(library(t or "")) // 4) for i, t in AWKWARD)
    back = bpe_matrix.decode(found, vocab[1])
    assert order((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()) == order((i, t or "") for i, t in AWKWARD)
    assert bpe_matrix.encode(docs([]), vocab[1], public_tokenizers.PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert [bytes(r["decoded"]) for r in bpe_matrix.decode(nothing, vocab[1]).collect()] == [b"", b""]
