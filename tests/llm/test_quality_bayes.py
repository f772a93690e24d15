import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsieve.llm import quality_bayes as q
from callsieve.llm.queries import op9_quality_bayes

SF = "/root/testdata/sf0.01"
fold = lambda i: zlib.crc32(str(i).encode()) % 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.filter("crc32(cast(doc_id as string)) % 2 = 1")
    rows = {r.doc_id: r for r in q.judge_documents(docs, seen, text=False).collect()}
    assert len(rows) == docs.count()
    unseen = [r for r in labels.collect() if not fold(r.doc_id)]
    clean = [rows[r.doc_id].accepted for r in unseen if r.quality == 1 and r.toxic == 0]
    junk = [rows[r.doc_id].accepted for r in unseen if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1, (np.mean(clean), np.mean(junk))


def test_posteriors_equal_brute_force(spark):
    rows = op9_quality_bayes(spark, SF).collect()
    place = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    p = {r.doc_id: r.evidence for r in rows}
    hosts, paths = {}, {}
    for i, (h, lang) in place.items():
        hosts.setdefault(h, []).append(p[i])
        paths.setdefault((h, lang), []).append(p[i])
    n, m = len(p), np.mean(list(p.values()))
    between = sum(len(x) * (np.mean(x) - m) ** 2 for x in hosts.values())
    kh = q._strength(m, between, len(hosts) - 1, n - sum(len(x) ** 2 for x in hosts.values()) / n)
    inner = sum(len(x) * (np.mean(x) - np.mean(hosts[h])) ** 2 for (h, _), x in paths.items())
    kp = q._strength(m, inner, len(paths) - len(hosts), n - sum(len(x) ** 2 / len(hosts[h]) for (h, _), x in paths.items()))
    for r in rows:
        h, path = hosts[place[r.doc_id][0]], paths[place[r.doc_id]]
        host = (kh * m + sum(h) - r.evidence) / (kh + len(h) - 1)
        own = (kp * host + sum(path) - r.evidence) / (kp + len(path) - 1)
        odds = r.evidence / (1 - r.evidence) * own / (1 - own) * (1 - m) / m
        assert (r.host_posterior, r.path_posterior, r.posterior) == pytest.approx((host, own, odds / (1 + odds)))
        assert r.accepted == (r.posterior >= 0.5)


def test_sparse_sites_shrink(spark):
    """A site of bad pages pulls its next page down; a site with one page hardly moves."""
    rows = [("bad", "x", 0.05)] * 200 + [("good", "x", 0.95)] * 200 + [("one", "x", 0.05), ("bad", "y", 0.5), ("one", "y", 0.5), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "host string, path string, evidence double")
    out = {(r.host, r.path): r for r in q.judged(df, q.path_prior(df), F.col("host"), F.col("path")).filter("evidence = 0.5").collect()}
    assert out["bad", "y"].posterior < 0.2 < out["one", "y"].posterior
    assert len(out) == 3


def test_odd_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 0), (9, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    out = q.judge_documents(messy.withColumn("evidence", F.lit("clash")), labels)
    assert out.count() == messy.count() and out.columns.count("evidence") == 1
    assert out.filter("posterior is null or not posterior between 0 and 1").count() == 0
    flat = q.judge_documents(messy, labels.limit(0))
    assert flat.filter("accepted and posterior = 0.5").count() == messy.count()
    assert q.judge_documents(nothing, labels).count() == 0


def dense_newton(x, y, counts, ridge):
    """The fit on a whole matrix, with exact steps."""
    w = np.zeros(x.shape[1])
    penalty = np.where(np.arange(len(w)) == len(w) - 1, 1e-6, ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty), x.T @ (counts * (y - p)) - penalty * w)
        w = w + step * min(1.0, 5.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return w


def test_evidence_equals_brute_force(spark):
    import xxhash

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: (r.quality != 1 or r.toxic == 1, r.toxic == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs}

    def words(text):
        cores = {t.strip("!?.,;:*$#&%|\"'()[]{}<>-_=+/\\~^`@").lower() for t in text.split()} - {""}
        parts = cores | {c[:n] + "*" for c in cores for n in q.PREFIXES if len(c) > n}
        return {xxhash.xxh64_intdigest(p.encode()) % q.WORD_SPACE for p in parts}

    ids = sorted(labels)
    own = {i: words(docs[i]) for i in docs}
    bad, toxic = (np.array([labels[i][k] for i in ids]) for k in (0, 1))
    seen = {}
    for i, b, t in zip(ids, bad, toxic):
        for w in own[i]:
            n = seen.setdefault(w, [0, 0, 0])
            n[0] += 1
            n[1] += b
            n[2] += t
    z = lambda c, n, rate: (c - n * rate) / np.sqrt(n * rate * (1 - rate))
    moves = lambda n, b: abs(z(b, n, bad.mean())) >= 4 and abs(b / n - bad.mean()) >= 0.1
    swears = lambda n, t: z(t, n, toxic.mean()) >= 4 and t / n >= 2 * toxic.mean()
    told = sorted(w for w, (n, b, t) in seen.items() if n >= 5 and (moves(n, b) or swears(n, t)))
    facts = q._Facts()
    shape = {i: np.array(q.features(text, facts.__getitem__)[0]) for i, text in docs.items()}
    fit = np.array([shape[i] for i in ids])
    row = lambda i: np.concatenate([(shape[i] - fit.mean(axis=0)) / (fit.std(axis=0) + 1e-9), [w in own[i] for w in told], [1]])
    w = dense_newton(np.array([row(i) for i in ids]), 1.0 - bad, np.where(toxic, q.TOXIC_WEIGHT, 1.0), q.RIDGE)
    for r in op9_quality_bayes(spark, SF).collect():
        p = 1 / (1 + np.exp(-row(r.doc_id) @ w))
        assert r.evidence == pytest.approx(min(1 - q.CLIP, max(q.CLIP, p)), abs=1e-5)


def test_held_out_toxic_documents_by_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("crc32(cast(doc_id as string)) % 4 <> 1")
    judged = q.judge_documents(docs, seen, text=False).join(labels.filter("crc32(cast(doc_id as string)) % 4 = 1"), "doc_id")
    out = {}
    for r in judged.collect():
        kind = "junk" if r.quality == 0 else "toxic" if r.toxic == 1 else "clean"
        out.setdefault((kind, r.lang), []).append(r.accepted)
    kept = {k: (sum(v), len(v)) for k, v in sorted(out.items())}
    print(kept)
    for (kind, lang), (n, of) in kept.items():
        assert n >= 0.97 * of if kind == "clean" else n <= 0.05 * of if kind == "junk" else n <= (0.25 if lang == "en" else 0.6) * of, kept
    toxic = [v for k, v in kept.items() if k[0] == "toxic"]
    assert sum(n for n, _ in toxic) <= 0.2 * sum(of for _, of in toxic), kept
