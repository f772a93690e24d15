import random
import re

import numpy as np
import pytest

from callsieve.llm import ngram_join as j
from callsieve.llm.grouping import components, forest


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    n = len(sets)
    links = [0] * n
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(n):
        for y in range(x):
            (i, a), (k, b) = sets[x], sets[y]
            if i is None or k is None or not a or not b:
                continue
            if len(a & b) >= 0.8 * len(a | b):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = {}
    for x in range(n):
        if sets[x][0] is not None:
            least[find(x)] = min(least.get(find(x), sets[x][0]), sets[x][0])
    return sorted(
        ((i, links[x], least.get(find(x)), i == least.get(find(x))) for x, (i, _) in enumerate(sets)), key=str
    )


def got(df):
    return sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def planted(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BUCKET_BLOCK", block)
    monkeypatch.setattr(j, "CLUSTER_BLOCK", block)
    rows = planted(3, 30)
    rows += [(900, None), (901, ""), (902, "?!"), (None, rows[0][1]), (903, "two words"), (904, "Two, words!"), (905, rows[1][1]), (905, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(3)
    out = got(j.similar_documents(df))
    want = brute(rows)
    want = [(i, n, c, True) if i is None else (i, n, c, k) for i, n, c, k in want]
    assert out == want
    kept = j.drop_similar(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, _, _, k in want if k and i is not None})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.similar_documents(df).count() == 0


def test_posterior_never_loses_a_link():
    """At the threshold itself hardly any pair may fall out."""
    rng = np.random.default_rng(1)
    n = 20000
    sig = rng.integers(0, 256, (n, j.VALUES)).astype(np.uint8)
    other = np.where(rng.random((n, j.VALUES)) < 0.8, sig, rng.integers(0, 256, (n, j.VALUES)).astype(np.uint8))
    both = np.vstack([sig, other])
    at = np.arange(n)
    assert len(j.survivors(both, at, at + n, j.least_equal())) >= n - 2
    far = np.where(rng.random((n, j.VALUES)) < 0.4, sig, rng.integers(0, 256, (n, j.VALUES)).astype(np.uint8))
    assert len(j.survivors(np.vstack([sig, far]), at, at + n, j.least_equal())) < n / 1000


def test_matrix_counts_equal_set_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 8000)).astype(np.uint64)) for _ in range(12)]
    common = j._common(sets, np.array([len(s) for s in sets]))
    for x in range(12):
        for y in range(12):
            if x != y:
                assert common[x, y] == len(np.intersect1d(sets[x], sets[y]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.component for r in rows}
    groups = {}
    for node, name in label.items():
        groups.setdefault(name, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 140)), [200, 201]]
    assert all(name in own for name, own in groups.items()) and len(rows) == len(label)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert forest(5, np.array([4, 3]), np.array([3, 1])) == [(1, 3), (1, 4)]
