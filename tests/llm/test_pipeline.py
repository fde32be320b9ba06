import random

import corpus_pipeline
from netloom.llm import language, registry, simhash
from netloom.session import run_dir

from .test_decontaminate import _brute
from .test_simhash import _components, _fingerprint


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "ro", "mi", "tu", "sch"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(60)]
    item = " ".join(word() for _ in range(15))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts[:10])]
    rows += [(200, texts[3] + " extra"), (201, "12 34 !!"), (202, None), (203, ""), (204, f"{texts[5][:200]} {item} {texts[6]}"), (0, texts[0])]
    path = run_dir(spark, "tables")
    spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, rows
    for number, (_, apply) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = apply(spark, docs, path)
        assert docs.columns == columns
        if number == 0:
            kept = [(i, t) for i, t in kept if any(c.isalpha() for c in t or "")]
        elif number == 1:
            best = {}
            for i, t in kept:
                best[_fold(t)] = max(best.get(_fold(t), (i, t)), (i, t))
            kept = list(best.values())
        elif number == 2:
            roots, first = _components([_fingerprint(t) for _, t in kept], 3), {}
            for r, (i, t) in zip(roots, kept, strict=True):
                first[r] = min(first.get(r, (i, t)), (i, t))
            kept = list(first.values())
        else:
            hit = {r[0] for r in _brute(kept, [(1, item)], 10) if r[5]}
            assert hit == {"204"}
            kept = [(i, t) for i, t in kept if str(i) not in hit]
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(kept)
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in kept}


def _tables(spark, rows, items, extra=""):
    path = run_dir(spark, "tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long" + extra
    more = (7, "x") if extra else ()
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), *more) for i, t, lang in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_awkward_tables(spark):
    """Repeated and missing identifiers with texts of their own, clashing further columns, no labels."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice(["ka", "ro", "mi", "tu"]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    texts = [text() for _ in range(8)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3].upper()), (2, texts[4]), (2, texts[4]), (3, texts[5]), (4, None), (5, "")]
    path = _tables(spark, [(*r, None) for r in rows], [], ", fp long, row string")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, apply(spark, docs, path)
        assert docs.schema.names == before.schema.names
    got = sorted((str(r["doc_id"]), _fold(r["text"])) for r in docs.collect())
    assert got == sorted((str(i), t) for i, t in [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (3, texts[5]), (5, "")])
    assert corpus_pipeline.run(spark, path).count() >= 6


def test_empty_tables(spark):
    path = _tables(spark, [], [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in registry.QUERIES] == list(range(1, 14))
    assert registry.SQL.keys() <= registry.QUERIES.keys()
    assert language.UNKNOWN == "und" and simhash.TILE_ROWS == 4096
