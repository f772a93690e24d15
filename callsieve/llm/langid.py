"""Language identification by compression.

Each language has a raw-content dictionary for zstandard, cut from its labelled
texts. A text is cut in blocks, and each block is compressed by itself with each
dictionary; the language whose dictionary gives the fewest bytes over all blocks
wins. A dictionary saves much in the first kilobytes after it and little later, so
without blocks the lead would not grow with the text. Where the best two are close,
the text is compressed again at a higher level; what is still close then is
rejected: texts in a language that was not learned, in several languages or in none.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.workers import map_arrow, worker_state

UNKNOWN = "und"
#: Bounds of the fit, for each language: sampled texts, characters taken of each,
#: bytes of the dictionary.
SAMPLE_TEXTS = 600
SAMPLE_CHARS = 600
DICTIONARY_BYTES = 64 << 10
LEVEL, CLOSE_LEVEL = 6, 12
#: Results count as close below this share of the best size, and below these bytes;
#: short texts are compressed at the higher level at once.
CLOSE, CLOSE_BYTES = 0.05, 3
SHORT_BYTES = 400
#: Bytes of a block; it ends after the next space, if one is near.
BLOCK_BYTES = 16 << 10

_NO_LETTERS = re.compile(r"[\W\d_]+")


class Model(NamedTuple):
    dictionaries: dict[str, bytes]


def letters(text: str) -> str:
    """What tells a language: words in lower case, single spaces between them."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def blocks(data: bytes) -> list[bytes]:
    """``data`` in blocks of about ``BLOCK_BYTES``, whole words where they are not very long."""
    parts, at = [], 0
    while len(data) - at > BLOCK_BYTES * 3 // 2:
        space = data.find(b" ", at + BLOCK_BYTES, at + BLOCK_BYTES * 5 // 4)
        end = space + 1 if space >= 0 else at + BLOCK_BYTES
        parts.append(data[at:end])
        at = end
    return [*parts, data[at:]]


def fit(
    docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Dictionaries of all languages that occur in the rows where ``training`` holds.

    About ``SAMPLE_TEXTS`` texts of each language, chosen by a hash of their ids, give a
    piece of ``SAMPLE_CHARS`` characters at a hashed place. Lines that occur in pieces
    of two languages (licences, code) tell nothing and are left out. Every sampled text
    has its share of the dictionary, in the order of a hash of the ids.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        (F.lit(True) if training is None else training).alias("use"),
    ).filter("use and lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_TEXTS / n))])
    place = F.xxhash64(F.lit("piece"), "id")
    size = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))
    piece = F.substr("text", (F.pmod(place, size) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    pieces = (
        rows.filter(F.pmod(F.xxhash64(F.lit("text"), "id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
        .select("lang", F.xxhash64(F.lit("order"), "id").alias("order"), piece.alias("piece"))
        .collect()
    )
    lines: dict[str, dict[str, int]] = {lang: {} for lang in counts}
    for i, r in enumerate(sorted(pieces, key=lambda r: (r.lang, r.order, r.piece))):
        for line in r.piece.split("\n"):
            lines[r.lang].setdefault(letters(line), i)
    seen = Counter(line for own in lines.values() for line in own)
    made = {}
    for lang, own in sorted(lines.items()):
        shares: dict[int, list[str]] = {}
        for line, i in own.items():
            if line and seen[line] == 1:
                shares.setdefault(i, []).append(line)
        content = b" ".join(_cut_evenly([" ".join(x).encode() for x in shares.values()], DICTIONARY_BYTES))
        made[lang] = content if len(content) >= 8 else b" " * 8
    return Model(made)


def _cut_evenly(pieces: list[bytes], size: int) -> list[bytes]:
    """The pieces, the longest ones cut to one length, so that all fit in ``size`` with a byte between them."""
    left = limit = size + 1  # the last piece needs no byte after it
    for i, n in enumerate(sorted(len(p) + 1 for p in pieces)):
        limit = left // (len(pieces) - i)
        if n > limit:
            break
        left, limit = left - n, size + 1
    return [p[: max(limit - 1, 0)] for p in pieces]


class Classifier:
    """Compressors of a model, in one worker."""

    def __init__(self, model: Model):
        import zstandard as z

        def compressors(level: int):
            made = []
            for lang, content in model.dictionaries.items():
                params = z.ZstdCompressionParameters.from_level(
                    level, dict_size=len(content), min_match=3,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                raw = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                made.append((lang, z.ZstdCompressor(dict_data=raw, compression_params=params).compress))
            return made

        self._fast, self._slow = compressors(LEVEL), compressors(CLOSE_LEVEL)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, score, accepted)``.

        The score is the share of the winner when each byte saved doubles the
        odds. A tie goes to the first language by name. Accepted is what wins by ``CLOSE``
        of the best size and ``CLOSE_BYTES`` at least; with one language nothing can be close.
        Sizes are sums over blocks, so a long text is accepted as its blocks are.
        """
        known = letters(text) if text else ""
        if not self._fast or not any(map(str.isalpha, known)):
            return UNKNOWN, 0.0, False
        data = known.encode()
        parts = blocks(data)
        close = len(data) < SHORT_BYTES
        while True:
            sizes = [(sum(len(compress(x)) for x in parts), lang) for lang, compress in (self._slow if close else self._fast)]
            best, lang = min(sizes)
            margin = min((n - best for n, other in sizes if other != lang), default=best)
            clear = margin >= max(CLOSE * best, CLOSE_BYTES)
            if close or clear:
                break
            close = True
        score = 1.0 / sum(2.0 ** max(best - n, -1000) for n, _ in sizes)
        return lang, score, clear


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score, accepted``.

    Columns of ``docs`` with these names are replaced. ``und`` (score 0, not
    accepted) for a NULL text, one without letters, and under a model without
    languages. Texts are taken whole, however long, and no length of a text in a learned
    language gets it rejected; repeated rows get the same answer each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.dictionaries)
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        classifier = worker_state("langid", key, lambda: Classifier(Model(shared.value)))
        found = [classifier.predict(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        lang, score, accepted = zip(*found)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
            [*batch.schema.names[:-1], "lang_pred", "score", "accepted"],
        )

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("_classified"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    fields = fields + ", " if fields else ""
    return map_arrow(slim, run, f"{fields}lang_pred string, score double, accepted boolean")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder ``fold``; false for NULL."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % folds == fold, F.lit(False))
