"""First-wins and last-wins de-duplication that survive one huge key group.

The obvious ``row_number()`` sends a whole key group to one task. Here the
winner of a group is a ``min``/``max`` of its ordinals: partial aggregates cut
a group to one small row per map task before anything moves, and texts are
matched back on the ordinal, which is unique and therefore never skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.session import fresh_dir


def first_ordinals(df: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """One row per key: its lowest ordinal, under the name of ``order``."""
    return df.groupBy(key).agg(F.min(order).alias(order)).select(order)


def mark_first(
    df: DataFrame, key: str, order: str = "ordinal", eligible: Column | None = None
) -> DataFrame:
    """Add ``is_first``: the row is the first eligible one of its key."""
    pool = df if eligible is None else df.filter(eligible)
    first = first_ordinals(pool.select(key, order), key, order)
    return df.join(first.withColumn("_first", F.lit(True)), order, "left").withColumn(
        "is_first", F.coalesce(F.col("_first"), F.lit(False))
    ).drop("_first")


def keep_first(df: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """Only the first row of every key."""
    return df.join(first_ordinals(df.select(key, order), key, order), order, "left_semi")


def keep_last_small(df: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """Only the last row of every key, for rows of a few scalars.

    The row travels inside the aggregate, so a hot key is cut to one row per
    map task and nothing is joined back.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_row"), F.max(order).alias(order)
    )
    return best.select(*keys, "_row.*", order).select(*df.columns)


def not_in(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in an existing table."""
    return df.join(seen.select(*keys), keys, "left_anti")


def keep_new(df: DataFrame, key: str, seen: DataFrame, order: str = "ordinal") -> DataFrame:
    """The first row of every key that no earlier drop has; ``seen`` has the keys of all of those.

    Only keys and ordinals are compared. The drop's winners, one row a key, are written first: as a
    scan they let Spark put a runtime Bloom filter of their keys before the shuffle of a large
    history, of which only rows that may match are then moved. What is found there is taken out
    of the drop. A NULL key is never found.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, "winners")
    first = df.groupBy(key).agg(F.min(order).alias(order))
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    any_key = F.length(F.col(key).cast("string")) >= 0  # a filter at the scan is what Spark asks for
    known = seen.select(key).join(first.filter(any_key).select(key), key, "left_semi")
    return df.join(not_in(first, known, [key]).select(order), order, "left_semi")
