"""How filters of a corpus interact: every order of them, from one pass of masks.

Each document gets a mask with one bit for each filter that it fails. Most filters
look at the text alone. The last one, "an earlier document has the same text", is
settled in two steps. A counting Bloom filter of all texts is built in parts, one a
task, and merged block by block; a text with a counter that nobody else has raised is unique
for certain. Only the others, possible repeats, are shuffled with their full text, to
find the least id of each text exactly.

Masks are counted by part of the corpus. All that any order of filters keeps,
removes, or would have removed is a sum of those counts, so the whole audit is
additive and its cost does not depend on the documents any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.llm.grouping import map_groups, written
from callsieve.llm.workers import bounded_batches, give_back

#: Counters of the sketch: in all for each document, in a block, raised by a text.
PER_DOCUMENT, BLOCK, PROBES = 8, 1 << 16, 3
#: Distinct counters a task holds before it hands them on.
HELD = 1 << 20
#: Bytes of the merged sketch, a bit for each counter, up to which it is broadcast.
SKETCH_BYTES = 64 << 20
#: Texts of which there are more copies than this share of all repeats are few enough to be broadcast.
HOT_SHARE = 1000

#: Fixed value: the characters between words.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not NULL."""
    found = words(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: The letter of the filter for repeated texts.
REPEATED = "E"


def sketch(texts: DataFrame, blocks: int) -> DataFrame:
    """``block, bits`` of ``texts (block, probes)``: a bit for each counter, set if it was raised twice or more.

    Tasks count into sparse parts of blocks, which are all that is shuffled: a text with
    any number of copies is a few counters of each task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def part() -> pa.RecordBatch:
            places, n = np.unique(np.concatenate(held), return_counts=True)
            block, first = np.unique(places // BLOCK, return_index=True)
            ends = np.append(first[1:], len(places))
            offsets, n = (places % BLOCK).astype("<u2"), np.minimum(n, 2).astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(block),
                    pa.array((ends - first).astype(np.int32)),
                    pa.array([offsets[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                ],
                ["block", "size", "offsets", "counts"],
            )

        for batch in batches:
            block, probes = (c.to_numpy() for c in batch.columns)
            for k in range(PROBES):
                held.append(block * BLOCK + (probes >> (16 * k) & (BLOCK - 1)))
            size += PROBES * len(block)
            if size >= HELD:
                yield part()
                held.clear()
                size = 0
        if held:
            yield part()
            held.clear()
        give_back()

    def merge(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        offsets, counts = (batch.column(c).to_pylist() for c in ("offsets", "counts"))
        bits = []
        for a, b in zip(starts, starts[1:]):
            counters = np.zeros(BLOCK, np.int64)
            for o, n in zip(offsets[a:b], counts[a:b]):
                counters[np.frombuffer(o, "<u2")] += np.frombuffer(n, np.uint8)  # places of a part are distinct
            bits.append(np.packbits(counters >= 2, bitorder="little").view("<i8"))
        return pa.RecordBatch.from_arrays(
            [batch.column("block").take(pa.array(starts[:-1])), pa.array(bits, pa.list_(pa.int64()))], ["block", "bits"]
        )

    bounded_batches(texts.sparkSession)
    parts = texts.select("block", "probes").mapInArrow(count, "block long, size int, offsets binary, counts binary")
    return map_groups(parts, ["block"], merge, "block long, bits array<long>", "size")


def _may_repeat() -> Column:
    """Whether all counters of a row's ``probes`` are set in ``bits``."""
    found = F.lit(True)
    for k in range(PROBES):
        place = F.shiftrightunsigned("probes", 16 * k).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
        word = F.element_at("bits", F.floor(place / 64).cast("int") + 1)
        found = found & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)) != 0)
    return found


def flag_documents(
    docs: DataFrame,
    part_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    filters: Mapping[str, Column] | None = None,
    sketch_bytes: int = SKETCH_BYTES,
) -> DataFrame:
    """``id_col, part, mask``, one row per row of ``docs``.

    Bit ``k`` of ``mask`` is set if the document fails the ``k``-th of ``filters`` (conditions on a
    column ``text``, by letter), the bit after them if a document of a smaller id has the
    same text, whatever else became of that one. A NULL text counts as empty, as does a NULL part.
    Rows of one id are no repeats of each other; rows without an id are nobody's repeat
    and make none. An empty table gives no rows, other columns are not read.

    The sketch has a bit for each of ``PER_DOCUMENT`` counters a document. Where that is more than
    ``sketch_bytes`` it is not broadcast: then no text is shuffled at all, and texts are
    the same if their SHA-256 is.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    filters = text_filters(F.col("text")) if filters is None else filters
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).alias("mask")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    blocks = max(1, -(-texts.count() * PER_DOCUMENT // BLOCK))
    known = [F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")]
    if blocks * BLOCK // 8 <= sketch_bytes:
        hashed = F.xxhash64("text")
        keyed = texts.withColumns({"block": F.pmod(hashed, F.lit(blocks)), "probes": F.xxhash64(F.lit("probes"), hashed)})
        merged = written(sketch(keyed, blocks), "sketch")
        looked = keyed.join(F.broadcast(merged), "block")
        slim = written(looked.select("id", "part", mask, F.when(_may_repeat(), digest).alias("digest")), "masks")
        firsts = looked.filter(_may_repeat()).groupBy("text").agg(*known).select(digest.alias("digest"), "first_id", "last_id", "n")
    else:
        slim = written(texts.select("id", "part", mask, digest.alias("digest")), "masks")
        firsts = slim.groupBy("digest").agg(*known)
    firsts = written(firsts.filter("last_id > first_id"), "firsts")
    repeats = firsts.agg(F.sum("n").alias("n")).first().n or 0
    hot, cold = (firsts.filter(c).select("digest", "first_id") for c in (F.col("n") * HOT_SHARE >= repeats, F.col("n") * HOT_SHARE < repeats))
    marked = slim.join(F.broadcast(hot), "digest", "left")
    settled = F.col("digest").isNull() | F.col("first_id").isNotNull()  # a NULL digest is no key to be shuffled by
    rest = marked.filter(~settled).drop("first_id").join(cold, "digest", "left")
    both = marked.filter(settled).select("id", "part", "mask", "first_id").union(rest.select("id", "part", "mask", "first_id"))
    repeated = F.when(F.col("id") > F.col("first_id"), 1 << len(bits)).otherwise(0)
    return both.select(F.col("id").alias(id_col), "part", (F.col("mask") + repeated).alias("mask"))


def mask_counts(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents fail just these filters, and how many labels say so.

    Labels are ``doc_id, quality, toxic``; an id is good if any of its labels has quality 1, toxic
    if any has toxic 1. Labels without an id, or of no document, count nowhere.
    """
    marks = (
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    )
    own = flags.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    labelled = own.join(marks, "id").select(
        "part", "mask", zero.alias("n"), (F.col("n") * F.coalesce("good", zero)).alias("good"), (F.col("n") * F.coalesce("toxic", zero)).alias("toxic")
    )
    counted = flags.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    return counted.union(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """What each step of each order of the filters does, for each part.

    ``counts`` are those of :func:`mask_counts`, ``letters`` names the bits from the lowest on. Returns
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``; every part has a row for every order and step. ``shapley`` sums what the step's
    filter removes over all orders.
    """
    n = len(letters)
    orders = "".join("".join(p) for p in permutations(letters))
    steps = F.sequence(F.lit(0), F.lit(len(orders) - 1))
    at = counts.withColumn("at", F.explode(steps))
    order = F.substr(F.lit(orders), (F.floor(F.col("at") / n) * n + 1).cast("int"), F.lit(n))
    at = at.select("*", order.alias("filter_order"), (F.col("at") % n + 1).cast("int").alias("step"))
    place = [F.instr("filter_order", x) for x in letters]
    before = sum((F.when(p < F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)), F.lit(0))
    at = at.withColumns({"before": before, "own": own})
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c, v="n": F.sum(F.when(c, F.col(v)).otherwise(0)).alias
    rows = at.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~gone)("kept"),
        total(fails & ~gone)("removed"),
        total(fails & gone)("redundant"),
        total(F.col("mask") == F.col("own"))("unique_fails"),
        total(fails & ~gone, "good")("good_lost"),
        total(fails & ~gone, "toxic")("toxic_lost"),
    )
    everywhere = Window.partitionBy("part", "own")  # as many rows as orders
    return rows.withColumn("shapley", F.sum("removed").over(everywhere)).drop("own")


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`audit` of the five filters of :func:`flag_documents` over whole texts."""
    flags = written(flag_documents(docs, part_col, id_col, text_col), "flags")
    counts = written(mask_counts(flags, labels, id_col), "mask-counts")
    return audit(counts, "".join(text_filters(F.col("text"))) + REPEATED)
