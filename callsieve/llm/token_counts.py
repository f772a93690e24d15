"""Token counts by map-side two-tier lookup of pre-token lengths.

A pre-token is a run of spaces with the run of other characters after it. No
piece of the model holds a space after another character (checked when the
model is loaded), so merges never cross a pre-token and the count of a text is
the sum over its pre-tokens. First tier: the lengths of the most frequent
pre-tokens, broadcast. Second tier: a bounded cache in each worker, filled by
encoding what the first tier misses. No pre-token is ever shuffled; what is
aggregated to find the frequent ones is a bounded summary of each task.

Which pre-tokens are frequent decides the speed, never a count.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.workers import bounded_batches, map_arrow, worker_state

#: Entries of the broadcast table, and of what one task proposes for it.
TABLE_SIZE = 65_536
TASK_SUMMARY = 8_192
#: Entries of a worker's cache; longer pre-tokens are encoded without it.
CACHE_SIZE = 400_000
CACHED_CHARS = 64

_RUNS = re.compile(r" *[^ ]+| +$")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space.

    The model puts one space before the text and takes U+2581 for a space.
    """
    if "▁" in text:
        text = text.replace("▁", " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


def frequent_pretokens(texts: DataFrame, column: str, size: int = TABLE_SIZE) -> list[str]:
    """At most ``size`` frequent pre-tokens of all texts, most frequent first.

    Each task keeps a bounded summary (the rarest entries go when it is full)
    and passes on its largest; only those summaries are shuffled.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pretokens(text))
                    if len(counts) > 16 * TASK_SUMMARY:
                        counts = Counter(dict(counts.most_common(4 * TASK_SUMMARY)))
        best = [x for x in counts.most_common(TASK_SUMMARY) if len(x[0]) <= CACHED_CHARS]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())],
                ["pretoken", "n"],
            )

    bounded_batches(texts.sparkSession)
    found = (
        texts.select(F.col(column).cast("string").alias("text"))
        .mapInArrow(summarise, "pretoken string, n long")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pretoken")
        .limit(size)
    )
    return [r.pretoken for r in found.collect()]


class _Lengths(dict):
    """Pre-token to number of tokens: the broadcast tier and a worker's own."""

    def __init__(self, encode, frequent: dict[str, int]):
        super().__init__(frequent)
        self._encode = encode
        self._frequent = frequent

    def __missing__(self, pretoken: str) -> int:
        if pretoken:
            n = len(self._encode(pretoken))
        else:  # one space at the end of a text; alone it would count as an empty text
            n = len(self._encode("a ")) - len(self._encode("a"))
        if len(pretoken) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE + len(self._frequent):
                self.clear()
                self.update(self._frequent)
            self[pretoken] = n
        return n


def _encoder(model: bytes):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("the model has pieces that cross pre-tokens")
    return processor.encode


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``, one row per row of ``docs``.

    ``model_path`` names a BPE model file of the sentencepiece library whose
    pieces stay within pre-tokens, with a dummy prefix and no normalisation.
    A NULL text counts as empty: no bytes, no tokens. Rows that repeat are
    counted one by one, NULL ids stay NULL, an empty table gives no rows, other
    columns of ``docs`` are not read. Texts are taken whole.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    length_of = _Lengths(_encoder(model), {})
    lengths = {p: length_of[p] for p in frequent_pretokens(texts, "text")}
    shared = docs.sparkSession.sparkContext.broadcast((model, lengths))
    key = uuid.uuid4().hex

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        def make():
            proto, frequent = shared.value
            return _Lengths(_encoder(proto), frequent)

        length = worker_state("token_counts", key, make).__getitem__
        text = batch.column("text")
        n = [sum(map(length, pretokens(x))) if x else 0 for x in text.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ],
            ["id", "n_bytes", "n_tokens", "over_limit"],
        )

    out = map_arrow(texts, count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
