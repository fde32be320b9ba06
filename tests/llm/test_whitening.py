import math

import numpy as np
import pytest

from netloom.llm import spectrum, whitening
from netloom.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, x string, component string, n string, i long, d long"


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "c", "n", 1, 2) for i, v in rows], SCHEMA)


def _brute(rows, components):
    """(vec_id, deviation, whitened components up to their signs), explained, and the covariance."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
              if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), (np.array([c - s / n for c, s in zip(x, sums, strict=True)]) @ vectors) / np.sqrt(values)) for i, x in usable]
    return n, out, values / np.trace(covariance)


def _compare(got, rows, components):
    n, brute, explained = _brute(rows, components)
    assert len(got) == len(brute) * len(explained)
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    signs = {}
    for i, deviation, whitened in brute:
        found = {r["component"]: r for r in by_row[i, deviation]}
        assert sorted(found) == list(range(1, len(explained) + 1))
        for k, r in found.items():
            assert r["n"] == n and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
            if abs(whitened[k - 1]) > 1e-6:
                sign = signs.setdefault(k, math.copysign(1, r["whitened"] * whitened[k - 1]))
                assert sign * r["whitened"] == pytest.approx(whitened[k - 1], rel=1e-6, abs=1e-8)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [5, 3, 2, 1, 0.5, 0.2]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [(7, rows[7][1]), (None, rows[8][1])]  # copies, also of an identifier
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2003, [float("nan")] * 6), (2004, [float("inf"), 1, 2, 3, 4, 5]), (2005, [float("-inf"), 1, 2, 3, 4, 5])]
    got = whitening.whiten(_frame(spark, rows), components=4).collect()
    _compare(got, rows, 4)


def test_query_equals_brute_force(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    _compare(got, rows, 16)


def test_undefined_components_are_left_out(spark):
    assert whitening.whiten(_frame(spark, [])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    three = whitening.whiten(_frame(spark, [(1, [0.0, 0.0, 5.0]), (2, [1.0, 0.0, 5.0]), (3, [0.0, 2.0, 5.0]), (4, [1.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in three) == [(i, k) for i in (1, 2, 3) for k in (1, 2)]


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(_frame(spark, rows)).collect()
    # the first entry's centre is exactly that of the third row; the second entries are 1000000, 1000064 and 1000128
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(1, None), (2, None), (3, (3 * 64) ** 2)} and {r["n"] for r in got} == {3}
    y = np.array([[10**15, -3], [-(10**15), 5], [7, 10**14]])
    assert whitening._products(y).tolist() == [[int(sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True))) for j in range(2)] for i in range(2)]


@pytest.mark.parametrize("kind", ["random", "equal", "low rank", "zero", "clusters", "indefinite"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_spectrum(kind, n):
    rng = np.random.default_rng(n)
    if kind == "random":
        a = rng.standard_normal((n, 2 * n))
        a = a @ a.T
    elif kind == "equal":
        a = 3 * np.eye(n)
    elif kind == "low rank":
        a = rng.standard_normal((n, max(1, n // 10)))
        a = a @ a.T
    elif kind == "zero":
        a = np.zeros((n, n))
    else:
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        w = np.repeat(np.arange(1, n // 3 + 2), 3)[:n].astype(float) if kind == "clusters" else rng.standard_normal(n)
        a = (q * w) @ q.T
        a = (a + a.T) / 2
    values, vectors = spectrum.leading(a, 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    norm = max(np.abs(a).sum(axis=1).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * norm
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12
    slices = spectrum.Slices(a)
    for shift in rng.standard_normal(5) * norm:
        assert slices.above(float(shift)) == int((np.linalg.eigvalsh(a) > shift).sum())
