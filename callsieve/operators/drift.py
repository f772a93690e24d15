"""Rolling drift of served verdicts against a baseline rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.functions.numeric import safe_ratio, two_bucket_psi
from callsieve.operators.ordering import ranges, with_starts
from callsieve.schemas import DriftPolicy

_BLOCK_WINDOWS = 16  # block length in windows: copies add 1/16 of the rows


def _status(df: DataFrame, policy: DriftPolicy, size: Column) -> DataFrame:
    psi = F.when(size > 0, two_bucket_psi(F.col("fraud_rate"), policy.baseline_fraud_rate))
    return df.withColumn("psi", F.coalesce(psi, F.lit(0.0))).withColumn(
        "alert", F.col("psi") > policy.psi_alert_threshold
    )


def sequence_positions(served: DataFrame, key: str = "key") -> DataFrame:
    """Add ``pos``: 1, 2, ... per key in ``(ts, event_id)`` order.

    Rows are dealt in ranges of key, time and event, so neither a key nor a burst
    within one second is ordered in one task.
    """
    placed = with_starts(ranges(served, [key], "ts", "event_id"), [key], _before=F.count(F.lit(1)))
    pos = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    return placed.withColumn("pos", pos).drop("_part", "_seq", "_first", "_before")


def rolling_drift(
    served: DataFrame,
    policy: DriftPolicy = DriftPolicy(),
    key: str = "key",
) -> DataFrame:
    """Rate, PSI and alert after every prediction over the last N of its key.

    ``served``: key, ``ts``, ``event_id``, boolean ``is_fraud``. The sequence of
    a key is cut into blocks of ``16 N`` rows; each block also gets the last
    ``N - 1`` rows before it, so windows are complete and no task holds more
    than one block at a time.
    """
    n = policy.window
    length = n * _BLOCK_WINDOWS
    placed = sequence_positions(served, key)
    index = F.col("pos") - 1
    block = F.floor(index / length)
    tail = index % length >= length - (n - 1)
    copies = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    spread = placed.select("*", block.alias("_home"), F.explode(copies).alias("_block"))
    w = Window.partitionBy(key, "_block").orderBy("pos").rowsBetween(-(n - 1), 0)
    rolled = (
        spread.withColumn("window_size", F.count(F.lit(1)).over(w))
        .withColumn("fraud_rate", F.avg(F.col("is_fraud").cast("int")).over(w))
        .filter(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )
    return _status(rolled, policy, F.col("window_size"))


def last_rows(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Last ``n`` rows per key; the bound is pushed below the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def window_status(rows: DataFrame, policy: DriftPolicy, key: str = "key") -> DataFrame:
    """Status per key from rows already cut to the window."""
    counted = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("window_size"), F.count_if("is_fraud").alias("_fraud")
    )
    rated = counted.withColumn("fraud_rate", safe_ratio(F.col("_fraud"), F.col("window_size")))
    return _status(rated.drop("_fraud"), policy, F.col("window_size"))


def drift_status(
    served: DataFrame, policy: DriftPolicy = DriftPolicy(), key: str = "key"
) -> DataFrame:
    """Where each key stands now: the last N rows only."""
    return window_status(last_rows(served, policy.window, key), policy, key)
