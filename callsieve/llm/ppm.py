"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts of up to ``ORDER`` bytes with counts of the
byte that follows. A byte is coded at the longest known context that has seen
it; each longer one is left by an escape. Escapes are estimated by method D: a
symbol seen ``n`` times weighs ``2 n - 1``, the escape one for each symbol. Symbols
that a longer context has seen are excluded from the shorter ones. The code
length of a text is the sum over its bytes and one end mark.

Texts are read as their tokens: capital A-Z lowered, split at ASCII white
space, joined by one space. No edge of the trie is left out, however rare, so
the model grows with the corpus and is never in one place: the distinct windows
of all texts (context and symbol, one combined aggregation) are dealt by their
nearest ``NEAR`` context bytes, which brings each one's longer contexts together,
and get their logarithms there. Edges of shorter contexts are broadcast for that; the
alphabet bounds them (``256**NEAR``), not the corpus.

Texts then need the logarithms of their windows: frequent windows (at least
``2**-EDGE_BITS`` of all) are broadcast, the others are joined. Token frequencies
for the base score go the same way (``2**-WORD_BITS`` of all tokens). What is
frequent decides the speed, never a score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import log10
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.grouping import map_groups, written
from callsieve.llm.langid import held_out
from callsieve.llm.workers import bounded_batches, give_back, worker_state

ORDER = 5
NEAR = 3
EDGE_BITS = 21
WORD_BITS = 18
#: Ends a text and stands for what is before it; no UTF-8 text holds it.
END = 0xFF
#: Bytes coded at once, and distinct n-grams and words a task holds.
SLICE = 1 << 20
HELD_GRAMS = 1_000_000
HELD_WORDS = 200_000


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


class Codes(NamedTuple):
    """Windows of ``ORDER + 1`` bytes of several texts, and where each text begins."""

    codes: np.ndarray
    starts: np.ndarray


def windows(texts: list[list[bytes]]) -> Codes:
    """One code for each predicted symbol: its context above, the symbol in the lowest byte."""
    pad, end = bytes([END]) * ORDER, bytes([END])
    parts = [b"".join((pad, b" ".join(t), end)) for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts]) - ORDER
    n = len(data) - ORDER
    code = np.zeros(n, np.uint64)
    for i in range(ORDER + 1):
        code = (code << np.uint64(8)) | data[i : i + n]
    ends = np.cumsum(size + ORDER)
    keep = np.ones(n, bool)
    for e in ends[:-1]:
        keep[e - ORDER : e] = False  # windows that reach into the next text's padding
    return Codes(code[keep], np.concatenate([[0], np.cumsum(size)[:-1]]))


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(tokens(text))
            size += len(text or "")
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _task_grams(texts: DataFrame) -> DataFrame:
    """``code, n`` of the longest n-grams of the one text column, summed in part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            code, n = _merged(codes, counts)
            for i in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[i : i + 100_000].astype(np.int64)), pa.array(n[i : i + 100_000])], ["code", "n"]
                )

        for texts in _sliced(batches):
            found = np.sort(windows(texts).codes)
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            codes.append(found[first])
            counts.append(np.diff(np.append(first, len(found))).astype(np.int64))
            held += len(first)
            if held >= HELD_GRAMS:
                one = _merged(codes, counts)
                codes, counts, held = [one[0]], [one[1]], len(one[0])
                if held >= HELD_GRAMS // 2:
                    yield from out()
                    codes, counts, held = [], [], 0
        if codes:
            yield from out()
        del codes, counts
        give_back()

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(count, "code long, n long")


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` of all tokens but the end marks of the one text column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            for i in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[i : i + 100_000], pa.binary()), pa.array(n[i : i + 100_000], pa.int64())], ["word", "c"]
                )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                if len(counts) >= HELD_WORDS:
                    yield from out()
                    counts.clear()
        yield from out()
        counts.clear()
        give_back()

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Trie(NamedTuple):
    """Sorted codes of the edges of each order with their counts; order 0 first."""

    codes: list[np.ndarray]
    counts: list[np.ndarray]


class _Order(NamedTuple):
    edges: np.ndarray
    log_count: np.ndarray
    contexts: np.ndarray
    log_total: np.ndarray  # as the longest known context
    log_escape: np.ndarray
    log_total_below: np.ndarray  # of the next shorter one, without what this one has seen
    log_escape_below: np.ndarray


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 for those that are not there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Ppm:
    """A trie ready for coding: logarithms to base 10.

    With ``shorter`` (coding its own orders only), ``model`` goes on from its orders.
    """

    def __init__(self, model: Trie, shorter: Ppm | None = None):
        self._orders: list[_Order] = list(shorter._orders) if shorter else []
        below = shorter._below if shorter else None
        ready = len(self._orders)
        if shorter:
            model = Trie(shorter._model.codes + model.codes, shorter._model.counts + model.counts)
        weights = [2 * n - 1 for n in model.counts]
        for order in range(ready, len(model.codes)):
            code, n = model.codes[order], weights[order]
            context = code >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.empty(0, int)
            names = context[first]
            size = np.diff(np.append(first, len(code)))
            total = np.add.reduceat(n, first) if len(code) else np.empty(0, np.int64)
            escape = size.astype(np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                if order:
                    shorter = _find(below[0], names & np.uint64((1 << 8 * (order - 1)) - 1))
                    seen = weights[order - 1][_find(model.codes[order - 1], code & np.uint64((1 << 8 * order) - 1))]
                    rest = below[1][shorter] - np.add.reduceat(seen, first) if len(code) else total
                    leave = below[2][shorter] - size
                    total_below, escape_below = np.log10(rest + leave), np.where(rest + leave > 0, np.log10(leave / (rest + leave)), 0.0)
                else:
                    leave = np.maximum(256 - size, 1)
                    total_below, escape_below = np.log10(leave), np.zeros(len(first))
                self._orders.append(
                    _Order(code, np.log10(n), names, np.log10(total + escape), np.log10(escape / (total + escape)), total_below, escape_below)
                )
            below = (names, total, escape)
        self._model, self._below = model, below

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the symbol of each window."""
        distinct, back = np.unique(codes, return_inverse=True)
        return self._descend(distinct)[back]

    def _descend(self, codes: np.ndarray) -> np.ndarray:
        logp = np.zeros(len(codes))
        left = np.arange(len(codes))
        above = np.full(len(codes), -1)
        for order in range(ORDER, -1, -1):
            t = self._orders[order]
            code = codes[left]
            context = _find(t.contexts, (code >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1))
            known = context >= 0
            longest = known & (above < 0)
            total, escape = np.zeros(len(left)), np.zeros(len(left))
            total[longest], escape[longest] = t.log_total[context[longest]], t.log_escape[context[longest]]
            later = known & (above >= 0)
            if later.any():
                up = self._orders[order + 1]
                total[later], escape[later] = up.log_total_below[above[later]], up.log_escape_below[above[later]]
            edge = np.where(known, _find(t.edges, code & np.uint64((1 << 8 * (order + 1)) - 1)), -1)
            hit = edge >= 0
            logp[left[hit]] += t.log_count[edge[hit]] - total[hit]
            logp[left[~hit]] += escape[~hit]
            left, above = left[~hit], context[~hit]
            if not len(left):
                return logp
        known = above >= 0
        logp[left[known]] -= self._orders[0].log_total_below[above[known]]
        logp[left[~known]] -= log10(256)
        return logp


class _HashTable:
    """Open addressing, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 1.5).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self._values = np.full(1 << bits, np.nan)
        at = self._home(keys)
        left = np.arange(len(keys))
        free = np.iinfo(np.uint64).max
        while len(left):
            place = at[left]
            empty = self._keys[place] == free
            self._keys[place[empty]] = keys[left[empty]]  # of several for one place the last one stays
            mine = self._keys[place] == keys[left]
            self._values[place[mine]] = values[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & self._mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that are not there."""
        at = self._home(keys)
        found = self._keys[at]
        out = self._values[at]
        left = np.flatnonzero(found != keys)
        free = np.iinfo(np.uint64).max
        while len(left):
            out[left] = np.nan
            left = left[self._keys[at[left]] != free]
            at[left] = (at[left] + 1) & self._mask
            same = self._keys[at[left]] == keys[left]
            out[left[same]] = self._values[at[left[same]]]
            left = left[~same]
        return out


def _keys(codes: np.ndarray) -> pa.Array:
    """Windows as join keys: eight bytes with a space, which no word holds."""
    raw = (codes | np.uint64(ord(" ") << 48)).astype(">u8")
    ends = np.arange(0, 8 * len(raw) + 1, 8, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _bytes_of(keys: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64) & np.uint64((1 << 48) - 1)


def priced(grams: DataFrame) -> DataFrame:
    """``key, m, logp`` of every window of ``grams (code, n, m)``.

    ``n`` is how often training texts have the window, 0 for one that is only asked for.
    """
    edge = F.col("code").bitwiseAND(F.lit((1 << 8 * NEAR) - 1))
    near = grams.filter("n > 0").groupBy(edge.alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = near.column("code").to_numpy().astype(np.uint64), near.column("n").to_numpy().astype(np.int64)
    short = [_merged([code & np.uint64((1 << 8 * (k + 1)) - 1)], [n]) if len(code) else (code, n) for k in range(NEAR)]
    shared = grams.sparkSession.sparkContext.broadcast(short)
    key = uuid.uuid4().hex

    def price(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        shorter = worker_state("ppm-shorter", key, lambda: Ppm(Trie(*map(list, zip(*shared.value)))))
        code = batch.column("code").to_numpy().astype(np.uint64)
        n = batch.column("n").to_numpy()
        seen, times = code[n > 0], n[n > 0].astype(np.int64)
        longer = [_merged([seen & np.uint64((1 << 8 * (k + 1)) - 1)], [times]) if len(seen) else (seen, times) for k in range(NEAR, ORDER + 1)]
        logp = Ppm(Trie(*map(list, zip(*longer))), shorter).code_lengths(code)
        return pa.RecordBatch.from_arrays([_keys(code), batch.column("m"), pa.array(logp)], ["key", "m", "logp"])

    context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * NEAR) - 1))
    return map_groups(grams.select(context.alias("near"), "code", "n", "m"), ["near"], price, "key binary, m long, logp double", "code")


def score_documents(
    docs: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    edge_bits: int = EDGE_BITS,
    word_bits: int = WORD_BITS,
) -> DataFrame:
    """``id_col, training, n_tokens, n_known, train_tokens, base_score, score``, one row per row.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of its tokens
    under add-one smoothed training frequencies; both take one end mark as a token.
    ``training`` says which rows the counts come from (all by default; NULL is no). A NULL
    text is empty and has its end mark only; without training rows every byte costs
    ``log10(256)`` and every token ``log10(1)``. Rows that repeat are learned and scored one
    by one, an empty table gives no rows, other columns are not read.
    """
    use = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        use.alias("training"),
        F.col(text_col).cast("string").alias("text"),
    )
    learned = texts.filter("training").select("text")
    asked = _task_grams(learned).select("code", "n", F.col("n").alias("m")).union(
        _task_grams(texts.filter("not training").select("text")).select("code", F.lit(0).cast("long"), "n")
    )
    grams = written(asked.groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "grams")
    prices = written(priced(grams), "prices")
    least_m = max(1, -(-(prices.agg(F.sum("m").alias("m")).first().m or 0) // 2**edge_bits))
    near = prices.filter(F.col("m") >= least_m).select("key", "logp").toArrow()
    windows_of = _bytes_of(near.column("key")), near.column("logp").to_numpy()
    counts = written(word_counts(learned), "words")
    facts = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learned.count()
    n, v = (facts.n or 0) + ends, facts.v + (ends > 0)
    least = max(1, -(-n // 2**word_bits))
    frequent = {bytes(r.word): r.c for r in counts.filter(F.col("c") >= least).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((windows_of, {w: log10(c + 1) for w, c in frequent.items()}))
    key = uuid.uuid4().hex
    log_all, log_end = log10(n + v + 1), log10(ends + 1)

    facts_type = pa.struct(
        [
            ("id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("logs", pa.float64()), ("score", pa.float64()),
        ]
    )
    schema = pa.schema([("row", pa.int64()), ("facts", facts_type), ("key", pa.binary()), ("tf", pa.int32())])

    def rows_of(held: list[tuple], table: _HashTable, logs: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
        """One row for each text, and one for each of its words and windows that are not frequent."""
        coded = windows([h[3] for h in held])
        logp = table.get(coded.codes)
        missed = np.flatnonzero(np.isnan(logp))
        logp[missed] = 0
        score = np.add.reduceat(logp, coded.starts)
        numbers = np.array([h[0] for h in held], np.int64)
        whole: list[tuple] = []
        rare: list[tuple] = []
        for (row, doc, train, words), s in zip(held, score.tolist()):
            known, total = int(ends > 0), log_end
            for word, tf in Counter(words).items():
                log = logs.get(word)
                if log is None:
                    rare.append((row, word, tf))
                else:
                    known += tf
                    total += tf * log
            whole.append((doc, train, len(words) + 1, known, total, s))
        facts = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*whole), facts_type)], fields=list(facts_type))
        own = pa.array([b" %d" % h[0] for h in held], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(numbers), facts, own, pa.nulls(len(whole), pa.int32())], schema=schema)
        for i in range(0, len(rare), 200_000):
            row, word, tf = zip(*rare[i : i + 200_000])
            none = pa.nulls(len(row), facts_type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), none, pa.array(word, pa.binary()), pa.array(tf, pa.int32())], schema=schema
            )
        text, code = np.searchsorted(coded.starts, missed, "right") - 1, coded.codes[missed]
        by = np.lexsort((code, text))
        text, code = text[by], code[by]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])) if len(code) else by
        times = np.diff(np.append(first, len(code))).astype(np.int32)
        text, code = text[first], code[first]
        for i in range(0, len(code), 200_000):
            row = pa.array(numbers[text[i : i + 200_000]])
            yield pa.RecordBatch.from_arrays(
                [row, pa.nulls(len(row), facts_type), _keys(code[i : i + 200_000]), pa.array(times[i : i + 200_000])], schema=schema
            )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            known, logs = shared.value
            return _HashTable(*known), logs

        table, logs = worker_state("ppm", key, make)
        held, size = [], 0
        for batch in batches:
            for row, doc, train, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((row, doc, train, tokens(text)))
                size += len(text or "")
                if size >= SLICE:
                    yield from rows_of(held, table, logs)
                    held, size = [], 0
        if held:
            yield from rows_of(held, table, logs)
        held = None
        give_back()

    bounded_batches(docs.sparkSession)
    names = facts_type.names
    kinds = "row long, facts struct<id: long, training: boolean, n_tokens: long, n_known: long, logs: double, score: double>, key binary, tf int"
    found = texts.mapInArrow(scored, kinds)
    rare_words = counts.filter(F.col("c") < least).select(F.col("word").alias("key"), F.log10(F.col("c") + 1).alias("log"))
    none = F.lit(None).cast("double")
    rare = rare_words.withColumn("logp", none).union(prices.filter(F.col("m") < least_m).select("key", none, "logp"))
    # a text's own row has a key that no word or window can be, so that those rows spread too;
    # a word that training texts do not have costs log10(0 + 1)
    joined = found.join(rare, "key", "left").select("row", *[F.col("facts")[c].alias(c) for c in names], "tf", "log", "logp")
    rare_log = F.sum(F.col("tf") * F.col("log"))
    rare_score = F.sum(F.col("tf") * F.col("logp"))
    rare_known = F.sum(F.when(F.col("log").isNotNull(), F.col("tf")))
    return (
        joined.groupBy("row")
        .agg(
            *[F.max(c).alias(c) for c in names],
            F.coalesce(rare_log, F.lit(0.0)).alias("rare_log"),
            F.coalesce(rare_score, F.lit(0.0)).alias("rare_score"),
            F.coalesce(rare_known, F.lit(0)).alias("rare_known"),
        )
        .select(
            F.col("id").alias(id_col),
            "training",
            "n_tokens",
            (F.col("n_known") + F.col("rare_known")).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("logs") + F.col("rare_log") - F.col("n_tokens") * log_all).alias("base_score"),
            (F.col("score") + F.col("rare_score")).alias("score"),
        )
    )


def seventh_held_out(id_col: str = "doc_id") -> Column:
    """The fold that :func:`score_documents` leaves out in the registered query."""
    return held_out(id_col, 7, 2)
