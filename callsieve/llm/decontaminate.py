"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, letters a-z (capital A-Z lowered) and characters
beyond ASCII. A window is ``n`` consecutive words of a benchmark item; an item
with fewer words is one window. Texts are scanned once: each row makes its own
windows, which are looked up in the set of benchmark windows. Windows are
compared as strings, so there are no hash collisions to verify. The set is
broadcast where its measured size allows, and joined by shuffling windows
otherwise; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.grouping import written

#: Fixed value: what a word is, after lowering A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of benchmark windows up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """The words of a text, an empty array for NULL."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def windows_of(word_array: Column, n: int) -> Column:
    """All windows of ``n`` words, as strings, in order; none if there are fewer."""
    count = F.size(word_array) - (n - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(word_array, i, F.lit(n)), " "))


def benchmark_windows(
    benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``window, size, items``: each distinct window with the items that have it.

    ``items`` are ids as strings. Items without words have no window; rows
    without an id count for hits but name no item.
    """
    item = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    windows = F.when(F.size("w") < n, F.array(F.array_join("w", " "))).otherwise(windows_of(F.col("w"), n))
    return (
        item.filter(F.size("w") > 0)
        .select("item", size.alias("size"), F.explode(F.array_distinct(windows)).alias("window"))
        .groupBy("window", "size")
        .agg(F.collect_set("item").alias("items"))
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, ``n_words, spans, items``.

    ``spans`` are the maximal hit stretches as ``(first, last)`` word numbers from 1,
    in order; ``items`` the distinct ids, as strings in string order, of the
    benchmark items with a window in the text. Rows that repeat are scanned one
    by one; NULL and empty texts have no words; an empty benchmark hits nothing.
    Columns of ``docs`` named as new ones are replaced.
    """
    found = benchmark_windows(benchmark, n)
    facts = found.agg(
        F.collect_set("size").alias("sizes"),
        F.sum(F.octet_length("window") + F.size("items") * 24 + 100).alias("bytes"),
    ).first()
    sizes = sorted(facts.sizes)
    small = (facts.bytes or 0) <= broadcast_bytes
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "spans", "items")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    scanned = docs.select(
        F.monotonically_increasing_id().alias("_row"), row.alias("_kept"), F.inline(F.array(F.struct(words(F.col(text_col)).alias("_w"))))
    )
    # the row itself is entry 0, its windows follow: one scan for counts and hits
    head = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("window")))
    entry = F.explode(F.concat(head, *[_entries(k) for k in sizes])).alias("e")
    looked = scanned.select("_row", "_kept", F.size("_w").alias("n_words"), entry).select(
        "_row",
        F.when(F.col("e.at") == 0, F.col("_kept")).alias("_kept"),
        F.when(F.col("e.at") == 0, F.col("n_words")).alias("n_words"),
        "e.at",
        "e.size",
        "e.window",
    )
    marked = found.withColumn("_hit", F.lit(True)).withColumnRenamed("size", "_size")
    joined = looked.join(F.broadcast(marked) if small else marked, "window", "left").filter("at = 0 or _hit")
    grouped = joined.groupBy("_row").agg(
        F.max("_kept").alias("_kept"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("at") > 0, F.struct("at", (F.col("at") + F.col("size") - 1).alias("last"))))).alias("_found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return grouped.select(
        *([F.col(f"_kept.`{c}`").alias(c) for c in kept]), "n_words", _merged(F.col("_found")).alias("spans"), "items"
    )


def _entries(k: int) -> Column:
    return F.transform(
        windows_of(F.col("_w"), k), lambda x, i: F.struct((i + 1).alias("at"), F.lit(k).alias("size"), x.alias("window"))
    )


def _merged(found: Column) -> Column:
    """Sorted ``(at, last)`` entries as maximal stretches."""
    kind = "array<struct<first:int,last:int>>"

    def step(state: Column, x: Column) -> Column:
        start, end, done = state["first"], state["last"], state["done"]
        joins = x["at"] <= end + 1
        return F.struct(
            F.when(joins, start).otherwise(x["at"]).alias("first"),
            F.when(joins, F.greatest(end, x["last"])).otherwise(x["last"]).alias("last"),
            F.when(joins | (end < 0), done).otherwise(F.concat(done, F.array(F.struct(start.alias("first"), end.alias("last"))))).alias("done"),
        )

    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last"), F.array().cast(kind).alias("done"))
    end = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(
        F.concat(end["done"], F.array(F.struct(end["first"].alias("first"), end["last"].alias("last"))))
    )


def hit_words(spans: Column) -> Column:
    """Number of words in the stretches."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its hit words; what stands between words stays."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    between = F.split(lowered, WORD)
    hits = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"])))
    own = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    kept = F.transform(own, lambda w, i: F.when(F.array_contains(hits, i + 1), F.lit("")).otherwise(w))
    joined = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(kept, i), F.lit(""))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(joined, ""))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", spans: bool = False
) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit words cut out.

    Documents with an id of a contaminated one go with it; those without an id are
    kept only if clean. Only ids and spans of contaminated documents are joined back.
    """
    found = find_hits(docs.select(id_col, text_col), benchmark, n, text_col).filter(F.size("spans") > 0)
    if not spans:
        gone = written(found.select(F.col(id_col).alias("_gone")).distinct(), "contaminated")
        return docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone")), "left_anti")
    one = found.groupBy(F.col(id_col).alias("_id")).agg(F.max("spans").alias("_spans"))
    cut = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut_spans(F.col(text_col), F.col("_spans")))
    joined = docs.join(one, docs[id_col].eqNullSafe(F.col("_id")), "left")
    return joined.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
