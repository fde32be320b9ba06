import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from netloom.llm import language

from .conftest import AWKWARD

_SOUNDS = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["schn", "ei", "ung", "ver"], "cc": ["éau", "que", "oi", "ment"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(_SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _rows(spark, rng):
    rows = [(i, _text(rng, lang, rng.randint(4, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(None if i is None else 10_000 + i, t, None) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, rows = _rows(spark, random.Random(1))
    found = {(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    by_id = {r[0]: r for r in found}
    labels = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 10_000}
    assert all(by_id[i][1] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in labels)
    held = [i for i in labels if by_id[i][1]]
    assert len(held) > 20 and np.mean([by_id[i][2] == labels[i] for i in held]) > 0.97
    assert all(by_id[10_000 + i][2:] == ("und", 0.0) for i in (1, 2, 3))
    assert all(0 <= r[3] <= 1 for r in found)
    kept = language.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_nothing_learned_means_unknown(spark, docs):
    found = language.identify(docs(AWKWARD)).collect()
    assert len(found) == len(AWKWARD) and {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert language.identify(docs([])).count() == 0


def test_bundles_equal_the_definition():
    def naive(text, gram, d, seed):
        points = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        points = [32, *points, 32]
        points = [p for i, p in enumerate(points) if i == 0 or p != 32 or points[i - 1] != 32]
        out = np.zeros(d)
        for i in range(len(points) - gram + 1):
            v = np.ones(d)
            for k in range(gram):
                v = v * np.roll(language._vector(points[i + k], d, seed), gram - 1 - k)
            out += v
        return out

    texts = ["Abc, de", "x", "ñandú 12 über", "a" * 50 + "!!" + "b" * 9]
    got = language.text_vectors(texts, [0, 1, 2, 3], 4, 3, 64, 5)
    for row, text in zip(got, texts, strict=True):
        assert np.array_equal(row, naive(text, 3, 64, 5))


def test_long_texts_in_slices(monkeypatch):
    text = "Der schnelle Fuchs, 12 mal; über den Zaun. " * 30
    whole = language.text_vectors([text], [0], 1, 3, 64, 5)
    monkeypatch.setattr(language, "SLICE_CHARS", 37)
    assert np.array_equal(language.text_vectors([text], [0], 1, 3, 64, 5), whole)


def test_stage_rejects_by_prediction(spark):
    rng = random.Random(9)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, say("abcde" if i % 2 else "mnopq", 60), "aa" if i % 2 else "mm") for i in range(60)]
    rows += [(100 + i, say("\u0431\u0432\u0433\u0434\u0436\u0437", 120), None) for i in range(10)] + [(200, "12 34 !!", None), (201, None, None), (202, "\u0431", None), (None, say("abcde", 60), None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, size int")
    stays = lambda found: sorted(str(r["doc_id"]) for r in found.collect())
    every = stays(language.accepted_documents(docs, least_score=0.08))
    assert every == sorted([*map(str, range(60)), "202", "None"])
    only = language.accepted_documents(docs, languages=["aa"], least_score=0.08)
    assert only.columns == docs.columns
    assert set(stays(only)) - {"202"} == {*map(str, range(1, 60, 2)), "None"}
    # Nothing to learn from: nothing is rejected.
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.accepted_documents(unlabelled, least_score=0.08).count() == len(rows)
    assert language.accepted_documents(docs.limit(0)).count() == 0
