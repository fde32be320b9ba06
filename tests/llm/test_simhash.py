import random
import re

import numpy as np
import xxhash

from netloom.llm import components, simhash

from .conftest import AWKWARD


def _fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius):
    values = np.array(prints, dtype=np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ value) <= radius):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [t for _, t in AWKWARD] + [" ".join(rng.choice(["Ab", "c", "dé", "\tx\n"]) for _ in range(n)) for n in range(40)]
    want = [_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t or "") for t in texts] == want
    monkeypatch.setattr(simhash, "SLICE_BYTES", 7)
    assert [simhash.fingerprint(t or "") for t in texts[:7] + texts[9:]] == want[:7] + want[9:]


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(2)
    prints = {0, 2**64 - 1}
    for _ in range(30):  # chains of near fingerprints, some longer than the radius
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    base = rng.getrandbits(16)
    prints |= {rng.getrandbits(48) << 16 | base for _ in range(700)}  # one hot block
    prints = sorted(prints)
    roots = _components(prints, 3)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for tile_rows in (20, 300, 4096):
        stars = {r["u"] % 2**64: r["v"] % 2**64 for r in components.stars(simhash.near_links(frame, 3, tile_rows)).collect()}
        classes = {}
        for p, r in zip(prints, roots, strict=True):
            assert classes.setdefault(r, stars.get(p, p)) == stars.get(p, p)
        assert len(set(classes.values())) == len(classes)


def test_documents(docs):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(5)]
    rows = list(AWKWARD)
    for k, text in enumerate(base):
        for c in range(8):
            words = text.split(" ")
            words[rng.randrange(300)] = f"changed{c}"
            rows.append((1000 + 10 * k + c, " ".join(words)))
    found = simhash.near_duplicates(docs(rows)).collect()
    assert len(found) == len(rows)
    prints = [_fingerprint(t) for _, t in rows]
    roots = _components(prints, 3)
    ids = {}
    for (i, _), r in zip(rows, roots, strict=True):
        ids.setdefault(r, []).append(i)
    want = sorted((str(i), f"{p:016x}", min((x for x in ids[r] if x is not None), default=None)) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_component_stays(docs):
    """Unrelated texts that share an identifier, or have none, all stay; of a component the smallest identifier does."""
    rng = random.Random(5)
    base = [" ".join(f"word{rng.randint(0, 999)}" for _ in range(200)) for _ in range(6)]
    near = [t.replace("word", "Word", 1) for t in base]  # the same shingles
    rows = [(1, base[0]), (1, base[1]), (2, near[0]), (None, base[2]), (None, near[2] + "  "), (None, base[3]), (7, near[3]), (8, base[4]), (8, base[4]), (9, near[4]),
            (11, near[5]), (11, base[5]), (3, None), (4, ""), (4, ""), (None, None)]
    found = simhash.one_of_each(docs(rows))
    assert found.columns == docs(rows).columns
    got = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert got.count((1, base[0])) == got.count((1, base[1])) == got.count((7, near[3])) == got.count((8, base[4])) == 1
    assert sum(i is None for i, _ in got) == 1 and sum(i == 11 for i, _ in got) == 1
    assert [i for i, t in got if not t] == [3]
    assert len(got) == 7
    prints = {(_fingerprint(t)) for _, t in rows}
    assert sorted(_fingerprint(t) for _, t in got) == sorted(prints)
    assert simhash.one_of_each(docs([])).count() == 0


def test_long_chains_become_one_star(spark):
    n = 200
    order = list(range(n))
    random.Random(6).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(7, 7), (None, 3)], "u long, v long")
    assert sorted(map(tuple, components.stars(links).collect())) == [(i, 0) for i in range(1, n)]
