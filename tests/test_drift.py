import math
from collections import deque

import pytest
from pyspark.sql import functions as F

from callsieve.functions.numeric import two_bucket_psi
from callsieve.operators import drift
from callsieve.schemas import DriftPolicy
from callsieve.streaming import monitor


def brute(flags, n):
    window, result = deque(maxlen=n), []
    for f in flags:
        window.append(f)
        rate = sum(window) / len(window)
        o = min(max(rate, 1e-6), 1 - 1e-6)
        psi = (o - 0.5) * math.log(o / 0.5) + (1 - o - 0.5) * math.log((1 - o) / 0.5)
        result.append((len(window), rate, psi, psi > 0.25))
    return result


def served(spark, n=4000):
    """Two thirds of the rows belong to one key; bursts share a time stamp."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 < 2, "hot").when(i % 9 != 8, F.concat(F.lit("k"), (i % 9).cast("string"))).alias("key"),
        F.timestamp_seconds(1700000000 + F.floor(i / 7) * 13).alias("ts"), i.alias("event_id"),
        (F.pmod(F.hash(i), F.lit(10)) < 4 + F.floor(i / 1500)).alias("is_fraud"),
    )


@pytest.mark.parametrize("window", [1, 7, 50])
def test_blocks_equal_a_plain_queue(spark, window):
    df = served(spark)
    got = {}
    for r in drift.rolling_drift(df, DriftPolicy(window=window)).collect():
        got.setdefault(r.key, {})[r.pos] = (r.window_size, r.fraud_rate, r.psi, r.alert)
    order = df.orderBy("ts", "event_id").collect()
    for key in {r.key for r in order}:
        want = brute([r.is_fraud for r in order if r.key == key], window)
        assert len(got[key]) == len(want)
        for pos, w in enumerate(want, start=1):
            assert got[key][pos] == pytest.approx(w, abs=1e-12)


def test_status_is_the_last_rolling_row(spark):
    df = served(spark)
    policy = DriftPolicy(window=40)
    now = {r.key: (r.window_size, r.fraud_rate, r.alert) for r in drift.drift_status(df, policy).collect()}
    order = df.orderBy("ts", "event_id").collect()
    for key, got in now.items():
        size, rate, _, alert = brute([r.is_fraud for r in order if r.key == key], 40)[-1]
        assert got == pytest.approx((size, rate, alert))


@pytest.mark.parametrize("rate,alert", [(0.5, False), (0.55, False), (0.7, False), (0.8, True), (0.0, True), (1.0, True)])
def test_psi_levels(spark, rate, alert):
    psi = spark.range(1).select(two_bucket_psi(F.lit(rate), 0.5).alias("p")).first().p
    assert (psi > 0.25) == alert
    if rate == 0.5:
        assert psi == 0


def test_stream_tail_equals_the_batch_status(spark, folder):
    """Several micro-batches, one replayed, end where one batch would."""
    df = served(spark, 900).cache()
    policy = DriftPolicy(window=25)
    for n, (lo, hi) in enumerate([(0, 100), (100, 650), (650, 900)]):
        batch = df.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi))
        monitor.update_drift(batch, n, f"{folder}/m", policy)
        if n == 1:
            monitor.update_drift(batch, n, f"{folder}/m", policy)
    ordered = lambda rows: sorted(map(tuple, rows), key=lambda r: str(r[0]))
    got = ordered(monitor.drift_gauges(spark, f"{folder}/m").collect())
    want = ordered(drift.drift_status(df, policy).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:], abs=1e-12)
    df.unpersist()


def test_live_rates_run_as_a_stream(spark, folder):
    rows = spark.range(100).select(
        F.timestamp_seconds(1700000000 + F.col("id") * 10).alias("ts"), F.lit("k").alias("key"),
        F.when(F.col("id") % 10 == 0, 503).otherwise(200).alias("status"),
        (F.col("id") % 4 == 0).alias("invalid"), (F.col("id") % 2 == 0).alias("is_fraud"),
    )
    rows.write.parquet(f"{folder}/in")
    q = (
        monitor.live_rates(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        .writeStream.format("memory").queryName("live").outputMode("complete")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    t = spark.table("live").agg(F.sum("requests").alias("n"), F.sum("errors").alias("e"), F.sum("invalid").alias("i")).first()
    assert (t.n, t.e, t.i) == (100, 10, 25)


def test_a_burst_is_not_one_task(spark):
    """All rows in one second of one key: the ranges share them out."""
    from callsieve.operators.ordering import ranges

    df = spark.range(4000).select(F.lit("k").alias("key"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.col("id").alias("event_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        sizes = [r["count"] for r in ranges(df, ["key"], "ts", "event_id").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 3000
    placed = drift.sequence_positions(df)
    assert placed.filter("pos <> event_id + 1").count() == 0
