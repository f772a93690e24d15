"""One-number row order, and joins that lose no row to a missing key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.session import fresh_dir

ROW_BITS = 48
#: Room for an ordinal of :func:`ordinal` as the row of another one.
NESTED_BITS = 60


def ordinal(rank: Column, row_idx: Column, bits: int = ROW_BITS) -> Column:
    """``(rank, row_idx)`` as one BIGINT with the same order.

    For rows below ``2**bits`` and ranks that leave the result below ``2**60``, or
    below ``2**63`` with nested ordinals; anything else fails the job. A plain number
    keeps ``min``/``max`` in the hash-aggregate fast path.
    """
    rank, row_idx = rank.cast("long"), row_idx.cast("long")
    ranks = 1 << ((NESTED_BITS if bits < NESTED_BITS else 63) - bits)
    fits = rank.between(0, ranks - 1) & row_idx.between(0, (1 << bits) - 1)
    both = F.shiftleft(rank, bits).bitwiseOR(row_idx)
    refused = F.raise_error(F.format_string("no place in the order for rank %d, row %d", rank, row_idx)).cast("long")
    return F.when(rank.isNull() | row_idx.isNull() | fits, both).otherwise(refused)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a NULL key part matches a NULL.

    Attaches what was aggregated per group to the rows of the group; grouping
    puts NULLs together, so the join has to as well.
    """
    names = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[n]) for k, n in names.items()])
    return left.join(other, same, how).drop(*names.values())


def ranges(df: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    """``df`` sorted by ``by`` and ``order`` in ranges of about equal size, with ``_part`` and ``_seq``.

    ``_part`` numbers the range, ``_seq`` grows by one from row to row inside it. Ranges
    are cut by sampled quantiles, so a key, a second or a score that holds most rows
    is spread as long as ``order`` tells its rows apart. Written to the shared folder:
    every later use sees the same ranges.
    """
    cut = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    numbered = cut.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    path = fresh_dir(df.sparkSession, "ranges")
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def with_starts(ranged: DataFrame, by: Sequence[str], **sums: Column) -> DataFrame:
    """Add ``_first`` (least ``_seq`` of the group in its range) and, for each of ``sums``,
    its total over the group's earlier ranges. One row for each group and range is moved."""
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "_part").agg(F.min("_seq").alias("_first"), *[c.alias(n) for n, c in sums.items()])
    starts = parts.withColumns({n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums})
    return join_null_safe(ranged, starts, [*by, "_part"])
