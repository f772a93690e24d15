import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from callsieve.llm import ppm
from callsieve.llm.queries import op10_ppm

SF = "/root/testdata/sf0.001"


class Slow:
    """PPM, escape method D, full exclusion, straight from the definition."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for t in texts:
            data = bytes([ppm.END]) * ppm.ORDER + normal(t) + bytes([ppm.END])
            for i in range(ppm.ORDER, len(data)):
                for k in range(ppm.ORDER + 1):
                    self.seen[k][data[i - k : i]][data[i]] += 1

    def symbol(self, context, s):
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            counts = self.seen[k].get(context[len(context) - k :])
            if counts is None:
                continue
            left = {x: n for x, n in counts.items() if x not in excluded}
            if not left:
                continue
            total = 2 * sum(left.values())
            if s in left:
                return p * (2 * left[s] - 1) / total
            p *= len(left) / total
            excluded |= set(left)
        return p / (256 - len(excluded))

    def score(self, text):
        data = bytes([ppm.END]) * ppm.ORDER + normal(text) + bytes([ppm.END])
        return sum(log10(self.symbol(data[i - ppm.ORDER : i], data[i])) for i in range(ppm.ORDER, len(data)))


def normal(text):
    return b" ".join((text or "").encode().lower().split())


def model_of(texts):
    code, n = np.unique(ppm.windows([ppm.tokens(t) for t in texts]).codes, return_counts=True)
    codes, counts = [], []
    for order in range(ppm.ORDER + 1):
        c, back = np.unique(code & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        codes.append(c)
        counts.append(np.bincount(back, n).astype(np.int64))
    return ppm.Ppm(ppm.Trie(codes, counts))


def test_equals_the_definition():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "la", "é", "x", "Q"]) for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(30)] + [None]
    slow, fast = Slow(texts), model_of(texts)
    for t in texts[:8] + ["", "new words zq", "ba", None, "\U0001f600 la"]:
        codes = ppm.windows([ppm.tokens(t)]).codes
        assert fast.code_lengths(codes).sum() == pytest.approx(slow.score(t))


def test_probabilities_sum_to_one():
    fast = model_of(["abra cadabra", "abracadabra é", "bar"])
    for context in (b"abrac", b"zzzab", b"qqqqq", bytes([255]) * 5):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** fast.code_lengths(np.array([base | s for s in range(256)], np.uint64))).sum() == pytest.approx(1)


def brute_base(rows, train):
    counts = Counter()
    for r, use in zip(rows, train):
        if use:
            counts.update(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r or "")))
            counts["\0end"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        t = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r or "")) + ["\0end"]
        out.append((len(t), sum(counts[x] > 0 for x in t), n, sum(log10((counts[x] + 1) / (n + v + 1)) for x in t)))
    return out


@pytest.mark.parametrize("bits", [ppm.WORD_BITS, 4])
def test_documents(spark, messy, nothing, bits):
    source = messy.select("doc_id", "text").collect()
    train = [r.doc_id is not None and r.doc_id != 3 for r in source]
    rows = ppm.score_documents(messy, (ppm.F.col("doc_id") != 3), word_bits=bits).collect()
    want = [(r.doc_id, t, *b) for r, t, b in zip(source, train, brute_base([r.text for r in source], train))]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted((tuple(r) for r in rows), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    slow = Slow([r.text for r, t in zip(source, train) if t and len(r.text or "") < 3000])
    assert slow.score("repeated row") < 0
    assert ppm.score_documents(nothing).count() == 0
    blank = ppm.score_documents(messy, ppm.F.lit(False)).filter("doc_id = 9").first()
    assert blank.score == pytest.approx(-(len("line one line two line three") + 1) * log10(256)) and blank.base_score == 0


def test_query_on_held_out_texts(spark):
    rows = op10_ppm(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    ids = sorted(texts)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    base = dict(zip(ids, brute_base([texts[i] for i in ids], [not out[i] for i in ids])))
    for r in rows:
        assert r.held_out == out[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == base[r.doc_id][:3]
        assert r.base_score == pytest.approx(base[r.doc_id][3])
    held = [r for r in rows if r.held_out]
    bits = -sum(r.score for r in held) / log10(2)
    size = sum(len(normal(texts[r.doc_id])) + 1 for r in held)
    assert bits / size < 2.7  # bits a byte of unseen texts, from 160 training texts


@pytest.mark.parametrize("bits", [ppm.EDGE_BITS, 5, 0])
def test_no_edge_is_left_out_whatever_is_broadcast(spark, bits):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "la", "é", "x", "Q", "1"]) for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["123456 \U0001f600", None, "the rare zyx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slow = Slow([t for i, t in enumerate(texts) if i % 3])
    rows = ppm.score_documents(docs, ppm.F.expr("doc_id % 3 > 0"), edge_bits=bits).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r.score == pytest.approx(slow.score(texts[r.doc_id]))
