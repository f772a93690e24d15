"""Exact percentiles of large groups: from counts by value, never from a buffer of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsieve.operators.ordering import ranges, with_starts


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """``keys`` and, by name, the percentile of ``value`` for each of ``shares`` (0 to 1).

    Between two ranks the value is interpolated, as ``percentile`` does; NULLs do not count, NULL
    keys are a group. Equal values are counted before anything moves. The counts are
    summed up over sampled ranges of values, so a group with very many distinct values is
    spread, and all that is held at a time is a row.
    """
    keys = list(keys)
    if not keys:
        return exact_percentiles(df.withColumn("_one", F.lit(1)), ["_one"], value, shares).drop("_one")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_starts(ranges(counts, keys, "_v"), keys, _before=F.sum("_n"))
    upto = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = placed.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    sizes = reached.groupBy(*keys).agg(F.max("_upto").alias("_all")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = reached.join(sizes, same)
    at = {name: (F.col("_all") - 1) * share for name, share in shares.items()}
    parts, out = [], []
    for i, (name, rank) in enumerate(at.items()):
        # the value at a rank is the first one that reaches beyond it
        parts += [
            F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_v"))).alias(f"_low{i}"),
            F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_v"))).alias(f"_high{i}"),
            F.max(rank - F.floor(rank)).alias(f"_over{i}"),
        ]
        low, high, over = F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_over{i}")
        out.append(F.when(low == high, low).otherwise(low * (1 - over) + high * over).alias(name))
    return joined.groupBy(*keys).agg(*parts).select(*keys, *out)
