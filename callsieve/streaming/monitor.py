"""Live monitoring: rolling drift per key and rates over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsieve.functions.numeric import safe_ratio
from callsieve.operators.drift import last_rows, window_status
from callsieve.schemas import DriftPolicy
from callsieve.session import path_exists

TAIL_COLUMNS = ("key", "ts", "event_id", "is_fraud")


def _tail_path(root: str, batch_id: int) -> str:
    return f"{root}/tail/batch_id={batch_id}"


def update_drift(batch: DataFrame, batch_id: int, root: str, policy: DriftPolicy) -> None:
    """Fold one micro-batch into the per-key tail and publish the status.

    The tail is the last N predictions of every key. A batch is cut to its own
    last N rows per key before the shuffle, so a key that holds most of the
    traffic still brings N rows per task. Tail N is written from tail N-1 and
    the batch only, hence a replayed batch gives the same tail.
    """
    spark = batch.sparkSession
    rows = last_rows(batch.select(*TAIL_COLUMNS), policy.window)
    previous = _latest_tail(spark, root, batch_id)
    if previous is not None:
        rows = rows.unionByName(previous.select(*TAIL_COLUMNS))
    target = _tail_path(root, batch_id)
    last_rows(rows, policy.window).write.mode("overwrite").parquet(target)
    tail = spark.read.parquet(target)
    window_status(tail, policy).write.mode("overwrite").parquet(
        f"{root}/status/batch_id={batch_id}"
    )


def _latest_tail(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    for n in range(batch_id - 1, -1, -1):
        if path_exists(spark, f"{_tail_path(root, n)}/_SUCCESS"):
            return spark.read.parquet(_tail_path(root, n))
    return None


def start_drift_monitor(
    served: DataFrame,
    root: str,
    policy: DriftPolicy = DriftPolicy(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """``served``: streaming ``(key, ts, event_id, is_fraud)``."""
    return (
        served.writeStream.foreachBatch(lambda df, n: update_drift(df, n, root, policy))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drift_gauges(spark: SparkSession, root: str) -> DataFrame:
    """Latest published status per key: that of the last whole batch, which knows all keys."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/status")
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    numbers = sorted((int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")), reverse=True)
    last = next(n for n in numbers if path_exists(spark, f"{root}/status/batch_id={n}/_SUCCESS"))
    return spark.read.parquet(f"{root}/status/batch_id={last}")


def live_rates(
    requests: DataFrame,
    length: str = "1 minute",
    slide: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Requests, errors, invalid outputs and fraud rate per window and key.

    Same expression on batch and streaming frames; partial counts are kept per
    window, so state grows with windows and keys, not with requests.
    """
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = (
        requests.withWatermark("ts", watermark)
        .groupBy(window.alias("w"), "key")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status") >= 500).alias("errors"),
            F.count_if("invalid").alias("invalid"),
            F.count_if("is_fraud").alias("fraud"),
        )
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        "key",
        "requests",
        "errors",
        "invalid",
        safe_ratio(F.col("fraud"), F.col("requests")).alias("fraud_rate"),
    )
