import hashlib
import random
import re

import numpy as np

from netloom.llm import decontaminate
from netloom.llm.fm_index import FMIndex

from .conftest import AWKWARD

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(rows, items, width):
    phrases = {}
    for item, text in items:
        words = _words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            phrases.setdefault(tuple(words[i : i + width]), set()).add(item)
    out = []
    for doc, text in rows:
        words, hit, named = _words(text), set(), set()
        for i in range(len(words)):
            for n in range(1, width + 1):
                if tuple(words[i : i + n]) in phrases and i + n <= len(words):
                    hit.update(range(i, i + n))
                    named |= phrases[tuple(words[i : i + n])]
        named = sorted(str(x) for x in named if x is not None)
        out.append((str(doc), len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def _case():
    rng = random.Random(8)
    vocabulary = ["a", "b", "C", "d2", "é"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 14)))) for i in range(12)]
    items += [(20, None), (21, "..."), (22, "zq"), (None, "b zz"), (23, items[0][1])]
    rows = [(i, " ".join(rng.choice([*vocabulary, "x,", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, f"x {items[i % 12][1]}. y") for i in range(60)] + AWKWARD + [(7, "ZQ zq b-zz")]
    return rows, items


def test_hits_equal_brute_force(spark, docs, monkeypatch):
    rows, items = _case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (1 << 20, 90):  # one block, and several passes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.contamination(docs(rows), bench, 6).select(columns).collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == _brute(rows, items, 6)


def test_clean_rows_stay_whole(spark, docs):
    rows, items = _case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean_documents(docs(rows), bench, 6)
    assert kept.columns == docs([]).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(r[0] for r in _brute(rows, items, 6) if not r[5])
    assert decontaminate.contamination(docs([]), bench).count() == 0
    assert decontaminate.contamination(docs(rows), bench.limit(0)).where("contaminated").count() == 0


def test_removal_leaves_no_phrase():
    assert decontaminate.without_spans("Aa, bb! cc dd.", [(1, 3)]) == "Aa,  dd."
    assert decontaminate.without_spans("x", []) == "x"


def test_index_finds_all_places():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 70, 400):
        text = np.append(rng.integers(0, 4, n), 0)
        if not text.any():
            continue
        index = FMIndex(text, sample=4)
        phrases = [p for k in (1, 2, 3, 5) for p in np.unique(rng.integers(1, 4, (30, k)), axis=0).tolist()]
        table = np.zeros((len(phrases), 5), dtype=np.int64)
        for i, p in enumerate(phrases):
            table[i, : len(p)] = p[::-1]
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
