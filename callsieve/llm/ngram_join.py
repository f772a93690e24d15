"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word five-grams. Texts with the same set form a class and are
handled as one. Each class has 128 MinHash values of one byte; classes that
agree in one of 32 bands of four values are candidates (a pair at the
threshold is missed with probability 5e-8). Candidates are compared value by
value in steps: with ``m`` of ``n`` equal, the posterior probability (uniform
prior) that the similarity reaches the threshold is a binomial tail; below
``TOLERANCE`` the pair is dropped. The rest is verified exactly on the sets.

Large buckets and clusters are cut in blocks that meet pair by pair inside
tasks. What leaves a task is a number of links for each text and a forest of
edges, never the pairs.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.grouping import block_pairs, components, forest, join_groups, map_groups, written
from callsieve.llm.workers import map_arrow, worker_state

WORDS = 5
THRESHOLD = 0.8
VALUES = 128
BAND = 4
STEP = 16
#: Least posterior probability of a link with which a candidate is kept.
TOLERANCE = 1e-6
BUCKET_BLOCK = 512
CLUSTER_BLOCK = 256
#: Five-grams that the texts of a block may have together.
BLOCK_GRAMS = 1_000_000

_WORD = re.compile(r"\w+")
_MASK = (1 << 64) - 1


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    draw = lambda: rng.integers(1, 1 << 63, VALUES, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(self) < 250_000 and len(word) <= 40:
            self[word] = h
        return h


def grams(text: str | None, hash_of, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; all words if there are fewer."""
    found = list(map(hash_of, _WORD.findall(text.lower()))) if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.array(found, np.uint64)
    n = min(words, len(w))
    out = np.full(len(w) - n + 1, 0x9E3779B97F4A7C15 * n & _MASK, np.uint64)
    for i in range(n):
        out = (out ^ w[i : len(w) - n + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(values: np.ndarray) -> bytes:
    """One byte of each of ``VALUES`` minima."""
    a, b = _mixers()
    low = np.full(VALUES, _MASK, np.uint64)
    for i in range(0, len(values), 2048):
        part = values[i : i + 2048, None] * a + b
        part ^= part >> np.uint64(29)
        np.minimum(low, (part * a).min(axis=0), out=low)
    low *= np.uint64(0xC4CEB9FE1A85EC53)
    return (low >> np.uint64(56)).astype(np.uint8).tobytes()


@lru_cache(8)
def least_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 16, 32, ... compared values, how many must be equal to go on.

    Values of one byte are equal by chance in one of 256 cases. With a uniform
    prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs ``(a[k], b[k])`` of signature rows stay, compared in steps."""
    left = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (sig[a[left], part] == sig[b[left], part]).sum(axis=1, dtype=np.int32)
        stay = equal >= need
        left, equal = left[stay], equal[stay]
        if not len(left):
            break
    return left


def _pairs(own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a block group: within block ``i``, or between ``i`` and ``j``."""
    if i == j:
        return np.triu_indices(len(own), 1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _hash_words():
    return worker_state("ngram_join", "words", _WordHashes).__getitem__


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``id, key, sig, n``: a fingerprint of the set (NULL if empty), its signature, its size."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hash_of = _hash_words()
        keys, sigs, sizes = [], [], []
        for text in batch.column("text").to_pylist():
            g = grams(text, hash_of, words)
            keys.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
            sigs.append(signature(g) if len(g) else None)
            sizes.append(len(g))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())],
            ["id", "key", "sig", "n"],
        )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(texts, run, "id long, key binary, sig binary, n long")


def _candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """A forest of the pairs that agree in a band and survive the comparison."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)),
        lambda i: F.struct(i.alias("band"), F.substring(F.col("sig"), i * BAND + 1, F.lit(BAND)).alias("values")),
    )
    rows = classes.select("key", F.inline(bands))
    shared = rows.groupBy("band", "values").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = rows.join(shared, ["band", "values"]).join(classes.select("key", "sig"), "key")
    blocks = F.ceil(F.col("members") / BUCKET_BLOCK)
    groups = block_pairs(members, F.col("key"), blocks).select("band", "values", "_i", "_j", "_own", "key", "sig")
    least = least_equal(threshold, tolerance)

    def step(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        sig = _bytes_matrix(batch.column("sig"), VALUES)
        own, i, j = (batch.column(c).to_numpy() for c in ("_own", "_i", "_j"))
        key = batch.column("key")
        found_a: list[int] = []
        found_b: list[int] = []
        small_a, small_b = [], []
        for s, e in zip(starts[:-1], starts[1:]):
            a, b = _pairs(own[s:e], i[s], j[s])
            if len(a) <= 64:
                small_a.append(a + s)
                small_b.append(b + s)
                continue
            stay = survivors(sig[s:e], a, b, least)
            for x, y in forest(e - s, a[stay], b[stay]):
                found_a.append(s + x)
                found_b.append(s + y)
        if small_a:
            a, b = np.concatenate(small_a), np.concatenate(small_b)
            stay = survivors(sig, a, b, least)
            found_a += a[stay].tolist()
            found_b += b[stay].tolist()
        take = lambda rows: key.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([take(found_a), take(found_b)], ["a", "b"])

    return map_groups(groups, ["band", "values", "_i", "_j"], step, "a binary, b binary", "key")


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``threshold``."""
    size = np.array([len(x) for x in sets])
    if len(a) <= 32:
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    else:
        common = _common(sets, size)[a, b]
    union = size[a] + size[b] - common
    return common >= threshold * union - 1e-9 * union


def _common(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    row, place = row[often[place]], number[place[often[place]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    width = 4096
    ends = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else -1) + width + 1, width))
    for k, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
        if e > s:
            part = np.zeros((len(sets), width), np.float32)
            part[row[s:e], place[s:e] - k * width] = 1
            common += (part @ part.T).astype(np.int64)
    return common


def _verified(docs: DataFrame, members: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """``key, other, links`` from blocks of clusters: forest edges, or a text's number of links."""

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        hash_of = _hash_words()
        sets = [grams(x, hash_of, words) for x in batch.column("text").to_pylist()]
        again = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets]
        names = [n for n in batch.schema.names if n != "text"]
        out = pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array([g.tobytes() for g in sets], pa.binary())], [*names, "grams"]
        )
        # an id that several texts share names the wrong ones too
        return out.filter(pa.array([x == y for x, y in zip(again, batch.column("key").to_pylist())], pa.bool_()))

    held = docs.join(members.withColumnRenamed("first_id", "id"), "id").select("key", "cluster", "sig", "copies", "blocks", "text")
    shingled = map_arrow(
        held, shingle, "key binary, cluster binary, sig binary, copies long, blocks long, grams binary"
    )
    groups = block_pairs(shingled, F.col("key"), F.col("blocks")).select(
        "cluster", "_i", "_j", "_own", "key", "sig", "copies", "grams"
    )
    least = least_equal(threshold, tolerance)

    def step(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        key = batch.column("key").to_pylist()
        sig = _bytes_matrix(batch.column("sig"), VALUES)
        copies, own, i, j = (batch.column(c).to_numpy() for c in ("copies", "_own", "_i", "_j"))
        grams_of = batch.column("grams")
        rows: list[tuple] = []
        for s, e in zip(starts[:-1], starts[1:]):
            at = [x for x, k in enumerate(key[s:e]) if k not in key[s : s + x]] if len(set(key[s:e])) < e - s else range(e - s)
            at = np.array(at) + s  # repeated rows of a text once
            a, b = _pairs(own[at], i[s], j[s])
            stay = survivors(sig[at], a, b, least)
            a, b = a[stay], b[stay]
            if not len(a):
                continue
            sets = [np.frombuffer(grams_of[int(x)].as_py(), np.uint64) for x in at]
            link = exact_links(sets, a, b, threshold)
            a, b = a[link], b[link]
            links = np.bincount(a, copies[at[b]], len(at)) + np.bincount(b, copies[at[a]], len(at))
            rows += [(key[at[x]], None, int(links[x])) for x in np.flatnonzero(links)]
            rows += [(key[at[x]], key[at[y]], 0) for x, y in forest(len(at), a, b)]
        k, o, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.binary()), pa.array(o, pa.binary()), pa.array(n, pa.int64())], ["key", "other", "links"]
        )

    return map_groups(groups, ["cluster", "_i", "_j"], step, "key binary, other binary, links long", "key")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, class_id, n_links, component_id, kept``.

    ``class_id`` is the smallest id of the texts with the same set, ``n_links`` the
    number of other rows whose similarity reaches ``threshold`` (copies included),
    ``component_id`` the smallest id reachable by links, ``kept`` whether that is the
    row's own id. Words are runs of letters, digits and underscores in lower case;
    fewer than ``words`` make one n-gram. NULL, empty and wordless texts and rows
    without an id link with nothing and are kept; their class is their id. Rows that
    repeat are copies of each other and share an id, so all of them are kept.
    Other columns are not read; an empty table gives no rows.
    """
    sketch = written(sketches(docs, id_col, text_col, words), "sketch")
    sets = sketch.filter("key is not null and id is not null")
    classes = written(
        sets.groupBy("key").agg(
            F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("sig").alias("sig"), F.max("n").alias("n")
        ),
        "classes",
    )
    clusters = components(written(_candidate_edges(classes, threshold, tolerance).distinct(), "candidates"))
    sizes = (
        clusters.join(classes.select("key", "n"), clusters["node"] == F.col("key"))
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
        .select(
            "component",
            "members",
            F.greatest(F.ceil(F.col("members") / CLUSTER_BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).alias("blocks"),
        )
    )
    members = (
        join_groups(clusters, written(sizes, "sizes"), "component", "members")
        .join(classes, F.col("node") == F.col("key"))
        .select("key", F.col("component").alias("cluster"), "first_id", "sig", "copies", "blocks")
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    verified = written(_verified(texts, written(members, "members"), words, threshold, tolerance), "verified")
    links = verified.filter("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    reach = components(verified.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = written(reach.join(classes.select("key", "first_id"), reach["node"] == F.col("key")).select("key", "component", "first_id"), "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    found = (
        classes.select("key", "first_id", "copies")
        .join(join_groups(named.select("key", "component"), written(least, "least"), "component", "members"), "key", "left")
        .join(links, "key", "left")
        .select("key", "first_id", "copies", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    )
    keyed = sketch.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
    placed = join_groups(keyed, written(found, "found"), "key", "copies")
    component = F.coalesce("component_id", "first_id", "id")
    return placed.select(
        F.col("id").alias(id_col),
        F.coalesce("first_id", "id").alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component.

    Rows that repeat with the same id are one document and leave one row; rows
    without an id stay. Only ids are joined back to the texts: those of dropped
    rows, and those that several kept rows share.
    """
    found = written(similar_documents(docs, id_col, text_col), "similar").filter(F.col(id_col).isNotNull())
    gone = written(found.filter(~F.col("kept")).select(id_col).distinct(), "gone")
    kept = docs.join(gone, id_col, "left_anti")
    again = written(found.filter("kept and n_links > 0").groupBy(id_col).count().filter("count > 1").select(id_col), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, id_col, "left_anti").select(*docs.columns)
    return once.union(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns))
