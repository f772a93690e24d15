"""Quality classifier: document evidence with host and path posteriors.

A logistic classifier of the text gives each document a probability of being
good. Grouped sums of these probabilities over all documents give each host and
each path of a host a posterior mean, by hierarchical empirical Bayes: a path is
shrunk toward its host, a host toward the whole, and how much is estimated from
the spread between groups (method of moments). A document's own probability is
taken out of its groups before they serve as its prior.

    logit P = logit(evidence) + logit(path posterior without it) - logit(overall mean)
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.grouping import written
from callsieve.llm.workers import map_arrow, worker_state

#: Bound of the fit: labelled documents. What has a weight is in at least ``LEAST_N`` of them, and
#: more often in bad or in toxic ones, or less often in bad ones, than chance explains; and it tells
#: something: it moves the share of bad ones by so much, or that of toxic ones by such a factor.
SAMPLE = 16_000
LEAST_N, LEAST_Z = 5, 4.0
LEAST_MOVE, LEAST_FACTOR = 0.1, 2.0
#: Besides words their beginnings, which words of one stem share.
PREFIXES = (3, 4, 5)
#: How many times a toxic document counts in the fit: they are few, and of few words each.
TOXIC_WEIGHT = 2.0
WORD_SPACE = 1 << 22
RIDGE = 0.2
#: Evidence is kept off 0 and 1, so that the groups have a say.
CLIP = 1e-4

SHAPES = (
    "length", "distinct", "most_common", "capitals", "marks", "symbols", "bars", "digits", "long_words", "lines_repeated", "stops", "adjacent",
)


class Model(NamedTuple):
    words: dict[int, int]  # hashed word to place
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # shapes, words, constant


class _Facts(dict):
    """What is known of a token: ``(hashed word and beginnings, flags)``."""

    def __missing__(self, token: str) -> tuple:
        core = token.strip("!?.,;:*$#&%|\"'()[]{}<>-_=+/\\~^`@")
        letters = sum(map(str.isalpha, token))
        word = core.lower()
        parts = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []
        made = (
            tuple(xxhash.xxh64_intdigest(x.encode()) % WORD_SPACE for x in parts),
            letters > 1 and token.upper() == token and token.lower() != token,
            token.endswith("!!") or token.endswith("??"),
            any(c in "*$#&%^~=@\\<>{}" for c in token),
            token == "|",
            any(map(str.isdigit, token)),
            len(token) > 18,
            token[-1] in ".!?",
        )
        if len(self) < 100_000 and len(token) <= 40:
            self[token] = made
        return made


def features(text: str | None, facts) -> tuple[list[float], set[int]]:
    """Shape numbers (as :data:`SHAPES`) and the hashed words and beginnings of words of a text."""
    tokens = text.split() if text else []
    if not tokens:
        return [0.0] * len(SHAPES), set()
    n = len(tokens)
    counts: dict[str, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    sums = [0] * 7
    words = set()
    for t, c in counts.items():
        f = facts(t)
        words.update(f[0])
        for i in range(7):
            if f[i + 1]:
                sums[i] += c
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, tokens, tokens[1:]))
    share = [(s / n) ** 0.5 for s in sums]
    return [
        np.log1p(n), len(counts) / n, (max(counts.values()) / n) ** 0.5, *share[:6],
        ((len(lines) - len(set(lines))) / max(1, len(lines))) ** 0.5, share[6], (same / n) ** 0.5,
    ], words


def _facts():
    return worker_state("quality", "facts", _Facts).__getitem__


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: int = SAMPLE) -> DataFrame:
    """``text, bad, toxic`` of about ``bound`` labelled documents, chosen by a hash of their ids.

    Bad is a quality of 0 or a toxic mark. Labels without an id or a quality do not
    count; of several for one id the worst does. The chosen labels are few enough to
    be broadcast whatever the tables' sizes.
    """
    one = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(
            F.max((F.col("quality") != 1) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    n = one.count()
    drawn = one.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < min(1.0, bound / max(n, 1)) * (1 << 30))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "_id").select("text", "bad", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The document classifier; None if the labels do not have good and bad documents."""
    sample = written(labelled_sample(docs, labels, id_col, text_col), "labelled")
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    rates = sample.agg(share("bad"), share("toxic")).first()
    if not rates.bad or rates.bad == 1.0:
        return None

    def word_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = _facts()
        found = [(w, bad, toxic) for text, bad, toxic in zip(*(c.to_pylist() for c in batch.columns)) for w in features(text, known)[1]]
        word, bad, toxic = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(bad, pa.bool_()), pa.array(toxic, pa.bool_())], ["word", "bad", "toxic"])

    def z(c: str) -> Column:
        rate = rates[c]
        return (F.col(c) - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate))) if 0 < rate < 1 else F.lit(0.0)

    tells_bad = (F.abs(z("bad")) >= LEAST_Z) & (F.abs(F.col("bad") / F.col("n") - rates.bad) >= LEAST_MOVE)
    tells_toxic = (z("toxic") >= LEAST_Z) & (F.col("toxic") / F.col("n") >= LEAST_FACTOR * rates.toxic)
    told = (
        map_arrow(sample, word_rows, "word long, bad boolean, toxic boolean")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("int")).alias(c) for c in ("bad", "toxic")])
        .filter((F.col("n") >= LEAST_N) & (tells_bad | tells_toxic))
        .orderBy("word")
        .collect()
    )
    words = {r.word: i for i, r in enumerate(told)}

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = _facts()
        found = [features(text, known) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("bad"),
                batch.column("toxic"),
                pa.array([f[0] for f in found], pa.list_(pa.float64())),
                pa.array([sorted(words[w] for w in f[1] if w in words) for f in found], pa.list_(pa.int32())),
            ],
            ["bad", "toxic", "shape", "words"],
        )

    rows = map_arrow(sample, vectors, "bad boolean, toxic boolean, shape array<double>, words array<int>").toArrow()
    shape = np.array(rows.column("shape").to_pylist(), float)
    mean, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-9
    dense = np.hstack([(shape - mean) / scale, np.ones((len(shape), 1))])
    lists = rows.column("words").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    good = 1.0 - rows.column("bad").to_numpy().astype(float)
    counts = np.where(rows.column("toxic").to_numpy(), TOXIC_WEIGHT, 1.0)
    w = logistic(dense, np.repeat(np.arange(len(shape)), sizes), lists.flatten().to_numpy(), len(words), good, counts)
    k = len(SHAPES)
    return Model(words, mean, scale, np.concatenate([w[:k], w[k + 1 :], w[k : k + 1]]))


def logistic(
    dense: np.ndarray, row: np.ndarray, column: np.ndarray, columns: int, y: np.ndarray, counts: np.ndarray, ridge: float = RIDGE, rounds: int = 25
) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method, its steps by conjugate gradients.

    Inputs are dense columns (the last one constant) and ones at ``(row, column)``, by row; ``counts`` says how
    often each row counts. Nothing larger than the ones themselves is made.
    """
    n, d = dense.shape
    by_column = np.argsort(column, kind="stable")
    up, across = row[by_column], np.flatnonzero(np.diff(column[by_column], prepend=-1))
    down = np.flatnonzero(np.diff(row, prepend=-1))
    rows, cols = row[down], column[by_column][across]
    penalty = np.full(d + columns, ridge)
    penalty[d - 1] = 1e-6
    w = np.zeros(d + columns)

    def forward(v: np.ndarray) -> np.ndarray:
        out = dense @ v[:d]
        if len(row):
            out[rows] += np.add.reduceat(v[d:][column], down)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        out = np.zeros(d + columns)
        out[:d] = dense.T @ r
        if len(row):
            out[d + cols] = np.add.reduceat(r[up], across)
        return out

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        gradient = back(counts * (y - p)) - penalty * w
        curve = counts * (p * (1 - p) + 1e-9)
        scale = back(curve) + penalty
        scale[:d] = ((dense * dense) * curve[:, None]).sum(axis=0) + penalty[:d]
        step, left = np.zeros_like(w), gradient.copy()
        ahead = side = left / scale
        size = left @ ahead
        goal = 1e-6 * size  # a thousandth of the gradient: the next round makes up for the rest
        for _ in range(100):
            if size <= goal:
                break
            bent = back(curve * forward(side)) + penalty * side
            move = size / (side @ bent)
            step += move * side
            left -= move * bent
            ahead = left / scale
            size, before = left @ ahead, size
            side = ahead + size / before * side
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:  # what is left is smaller by another factor of a thousand
            break
    return w


def with_evidence(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``evidence``, the classifier's probability of a good text.

    A column of that name is replaced. Without a model it is 0.5. NULL, empty and blank
    texts are read as texts of no words.
    """
    kept = [c for c in docs.columns if c != "evidence"]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.5).alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain values: workers need not import this package
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, known = worker_state("quality", key, lambda: (Model(*shared.value), _Facts()))
        k, out = len(SHAPES), []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            shape, words = features(text, known.__getitem__)
            score = float((np.array(shape) - m.mean) / m.scale @ m.weights[:k]) + m.weights[-1]
            score += sum(m.weights[k + m.words[w]] for w in words if w in m.words)
            out.append(min(1 - CLIP, max(CLIP, 1 / (1 + np.exp(-max(-30.0, min(30.0, score)))))))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], "evidence"])

    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("_judged"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    return map_arrow(slim, run, f"{fields}evidence double")


class Prior(NamedTuple):
    """Sums by path with those of its host, and what shrinks them."""

    groups: DataFrame  # host, path, n, s, host_n, host_s
    mean: float
    host_strength: float
    path_strength: float


def path_prior(evidence: DataFrame) -> Prior:
    """Grouped sums of ``host, path, evidence`` rows and the strength of shrinkage.

    Sums are combined before the shuffle, so a host with a third of all documents
    is one row from each task. NULL hosts and paths are groups of their own.
    """
    paths = written(
        evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")), "paths"
    )
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    groups = written(
        paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h"), "groups"
    )
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count(F.lit(1)).alias("k"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn")).first()
    if not whole.n:
        return Prior(groups, 0.5, 1.0, 1.0)
    mean = min(1 - CLIP, max(CLIP, whole.s / whole.n))
    between = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_s") / F.col("host_n") - mean, 2)).alias("x")).first().x
    inner = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n"), 2)).alias("x"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * F.col("n") / F.col("host_n")).alias("nn"),
    ).first()
    return Prior(
        groups,
        mean,
        _strength(mean, between, whole.k - 1, whole.n - whole.nn / whole.n),
        _strength(mean, inner.x, inner.k - whole.k, whole.n - inner.nn),
    )


def _strength(mean: float, between: float, free: float, size: float) -> float:
    """Prior documents: what spread is left after that of sampling, as a Beta prior."""
    unit = mean * (1 - mean)
    if free <= 0 or size <= 0:
        return 1e6
    variance = (between - free * unit) / size
    return 1e6 if variance <= unit * 1e-6 else min(1e6, max(1.0, unit / variance - 1))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judged(evidence: DataFrame, prior: Prior, host: Column, path: Column, cutoff: float = 0.5) -> DataFrame:
    """``evidence`` rows with ``host_posterior, path_posterior, posterior, accepted``."""
    groups = prior.groups.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in ("n", "s", "host_n", "host_s")]
    )
    m, kh, kp = prior.mean, prior.host_strength, prior.path_strength
    own = F.col("evidence")
    by_host = (kh * m + F.col("_host_s") - own) / (kh + F.col("_host_n") - 1)
    by_path = (kp * F.col("host_posterior") + F.col("_s") - own) / (kp + F.col("_n") - 1)
    kept = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), F.col("path_posterior")))
    odds = _logit(own) + _logit(kept) - float(np.log(m / (1 - m)))
    out = (
        evidence.withColumns({"_hk": host.cast("string"), "_pk": path.cast("string")})
        .join(groups, F.col("_hk").eqNullSafe(F.col("_host")) & F.col("_pk").eqNullSafe(F.col("_path")), "left")
        .withColumn("host_posterior", by_host)
        .withColumn("path_posterior", by_path)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("accepted", F.col("posterior") >= cutoff)
    )
    return out.drop("_hk", "_pk", *groups.columns)


def judge_documents(
    docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", text: bool = True
) -> DataFrame:
    """``docs`` with ``evidence, host_posterior, path_posterior, posterior, accepted``.

    One row per row of ``docs``, rejected ones included; columns with these names are
    replaced. With ``text`` false the text is left out and texts are scored once;
    otherwise they are scored again on the way out, which costs less than shuffling
    them. Where labels do not have both kinds, every posterior is 0.5 and every document
    accepted. NULL and empty texts are judged as texts without words, NULL hosts and
    paths are groups, rows that repeat count each, an empty table gives no rows.
    """
    made = ("evidence", "host_posterior", "path_posterior", "posterior", "accepted")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    model = fit(docs, labels, id_col, text_col)
    names = dict.fromkeys([id_col, host_col, path_col])
    slim = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    scored = written(with_evidence(slim, model, "_text").drop("_text"), "evidence")
    prior = path_prior(scored.select(F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), "evidence"))
    rows = with_evidence(docs, model, text_col) if text else scored
    return judged(rows, prior, F.col(host_col), F.col(path_col))
