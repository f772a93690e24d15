import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsieve.operators import boosting as B
from callsieve.plans.queries import CONTROL, control_scores

SF = "/root/testdata/sf0.001"


def brute(weights, labels, keys, drawn_rows, drawn_terms, trees, depth, step, bins, penalty=1.0, least=1.0):
    """The same fit on a dense matrix, one node at a time."""
    terms = sorted({t for _, t, _ in weights})
    tid = {t: i for i, t in enumerate(terms)}
    at = {k: i for i, k in enumerate(keys)}
    x = np.zeros((len(keys), len(terms)), int)
    for t in terms:
        own = sorted(w for _, u, w in weights if u == t)
        cuts = sorted({own[max(0, int(np.ceil(len(own) * i / bins)) - 1)] for i in range(1, bins)})
        for k, u, w in weights:
            if u == t and k in at:
                x[at[k], tid[t]] = 1 + sum(c < w for c in cuts)
    fit = np.array([at[k] for k in labels])
    y = np.array([int(v) for v in labels.values()])
    base = np.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(keys), base)
    for t in range(trees):
        use = np.array([drawn_rows(t, keys[i]) for i in fit])
        rows = fit[use]
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = np.rint((p - y[use]) * B.UNIT).astype(int), np.rint(p * (1 - p) * B.UNIT).astype(int)
        columns = [j for j in range(len(terms)) if drawn_terms(t, j)]

        def grow(mine, everyone, level):
            ga, ha = int(g[mine].sum()), int(h[mine].sum())
            score = lambda a, b: float(a) * a / (b + penalty * B.UNIT)
            best = None
            for j in columns if level < depth and mine.any() else ():
                for b in sorted(set(x[rows[mine], j]) - {0}):
                    right = mine & (x[rows, j] >= b)
                    gr, hr = int(g[right].sum()), int(h[right].sum())
                    gain = score(ga - gr, ha - hr) + score(gr, hr) - score(ga, ha)
                    if ha - hr >= least * B.UNIT and hr >= least * B.UNIT and gain > 1e-9 * B.UNIT:
                        best = max(best or (gain, -j, -b), (gain, -j, -b))
            if best is None:
                margin[everyone] -= step * ga / (ha + penalty * B.UNIT)
                return
            j, b = -best[1], -best[2]
            for side in (x[:, j] >= b, x[:, j] < b):
                grow(mine & side[rows], everyone & side, level + 1)

        grow(np.ones(len(rows), bool), np.ones(len(keys), bool), 0)
    return {k: 1 / (1 + np.exp(-m)) for k, m in zip(keys, margin)}


def hashed(spark, df, column, share, trees, seed=42):
    """What the hash draws, worked out by Spark for every tree at once."""
    out = {}
    for t in range(trees):
        for r in df.select(F.col(column).alias("c"), B._drawn(F.col(column), share, t, seed).alias("d")).collect():
            out[t, r.c] = r.d
    return lambda t, c: out[t, c]


@pytest.mark.parametrize("every", [10, 2])
def test_equals_brute_force(spark, monkeypatch, every):
    monkeypatch.setattr(B, "EVERY", every)
    rng = random.Random(5)
    weights, labels = [], {}
    for k in range(120):
        bad = rng.random() < 0.4
        for term in "abcdefgh":
            if rng.random() < (0.7 if bad and term in "ab" else 0.3):
                weights.append((k, term, round(rng.random() + (0.5 if bad and term == "c" else 0), 2)))
        if k % 6:
            labels[k] = bad
    df = spark.createDataFrame(weights, "key long, term string, weight double").repartition(4)
    lab = spark.createDataFrame(list(labels.items()), "key long, label boolean")
    keys = spark.range(120).select(F.col("id").alias("key"))
    size = {"trees": 5, "depth": 3, "step": 0.3, "bins": 4}
    model = B.fit_boosted(df, lab, "key", row_share=0.8, column_share=0.8, **size)
    got = {r.key: (r.score, r.pred) for r in B.score_boosted(model, df, keys, "key").collect()}
    tids = spark.range(8).select(F.col("id").cast("int").alias("tid"))
    want = brute(weights, labels, list(range(120)), hashed(spark, lab, "key", 0.8, 5), hashed(spark, tids, "tid", 0.8, 5), **size)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v, abs=1e-9) and got[k][1] == (v >= 0.5)
    again = B.fit_boosted(df.repartition(7), lab.repartition(3), "key", row_share=0.8, column_share=0.8, **size)
    assert again.trees == model.trees


def test_one_label_is_not_enough(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "key long, term string, weight double")
    with pytest.raises(ValueError):
        B.fit_boosted(df, df.select("key", F.lit(True).alias("label")), "key", trees=1)


def test_query_separates_labels(spark):
    rows = {r.doc_id: r.score for r in control_scores(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and CONTROL["trees"] == 10
    bad = [rows[r.doc_id] for r in labels if r.quality == 0 and r.doc_id % 5 > 0]
    good = [rows[r.doc_id] for r in labels if r.quality == 1 and r.doc_id % 5 > 0]
    assert np.mean(bad) > np.mean(good) + 0.2


def test_scoring_looks_up_only_terms_that_split(spark, monkeypatch):
    asked, real = [], B.binned

    def counted(weights, terms, *rest):
        asked.append(terms.count())
        return real(weights, terms, *rest)

    monkeypatch.setattr(B, "binned", counted)
    terms = spark.createDataFrame([("a", 0, [0.5]), ("b", 1, [0.5]), ("c", 2, [0.5])], "term string, tid int, cuts array<double>")
    weights = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (2, "b", 0.2), (3, "c", 0.9)], "key long, term string, weight double")
    model = B.Boosted(0.0, [B.Tree({1: B.Split(1, 1)}, {2: -1.0, 3: 1.0})], terms)
    got = {r.key: r.pred for r in B.score_boosted(model, weights, spark.range(1, 5).select(F.col("id").alias("key")), "key").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert asked == [1]
