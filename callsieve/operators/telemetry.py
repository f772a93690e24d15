"""Request counters, latency histograms, sliding rates and the load table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.functions.numeric import safe_ratio
from callsieve.operators.ordering import join_null_safe, ranges

# --- fixed values ---------------------------------------------------------
# Upper bounds in seconds of the latency buckets, and table percentiles.
LATENCY_BOUNDS = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"),
)
PERCENTILES = (0.5, 0.66, 0.75, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999, 0.9999, 1.0)
# --------------------------------------------------------------------------


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def _bucket_counts(seconds: Column) -> list[Column]:
    return [F.count_if(seconds <= b).alias(f"_le{i}") for i, b in enumerate(LATENCY_BOUNDS)]


def _bucket_array() -> Column:
    return F.array(*[F.col(f"_le{i}") for i in range(len(LATENCY_BOUNDS))])


def latency_histogram(requests: DataFrame) -> DataFrame:
    """Cumulative ``(endpoint, le, requests)``, one pass over the rows."""
    wide = requests.groupBy("endpoint").agg(*_bucket_counts(F.col("latency_ms") / 1000))
    pairs = F.arrays_zip(F.array(*[F.lit(b) for b in LATENCY_BOUNDS]).alias("le"),
                         _bucket_array().alias("requests"))
    return wide.select("endpoint", F.explode(pairs).alias("b")).select(
        "endpoint", F.col("b.le").alias("le"), F.col("b.requests").alias("requests")
    )


def _panes(requests: DataFrame, keys: Sequence[str], aggs: list[Column], step: int) -> DataFrame:
    """Counts per key and step-long pane: all later work is on these."""
    pane = F.floor(F.unix_seconds("ts") / step) * step
    return requests.groupBy(*keys, pane.alias("_pane")).agg(*aggs)


def _sliding(
    panes: DataFrame, keys: Sequence[str], names: Sequence[str], length: int, step: int, value: Column | None = None
) -> DataFrame:
    """Sums of ``names``, or ``value`` made of them, at each evaluation time ``t`` (epoch seconds) that a pane counts for.

    A pane that begins at ``p`` lies in the range ``(t - length, t]`` for
    ``t = p + step, p + 2 step, ..., p + length``: it is added at the first of these times and
    taken off after the last one. Running sums of the changes, over sampled ranges of
    time, are the values; between two changes they stay, so ``value`` is worked out once for each change and
    rows are repeated last.
    A pane is two rows of a shuffle, however long the range is.
    """
    keys = list(keys)
    row = lambda t, sign: F.struct(t.alias("t"), F.lit(sign).alias("_sign"))
    ends = F.array(row(F.col("_pane") + step, 1), row(F.col("_pane") + length + step, -1))
    changes = (
        panes.withColumn("_end", F.explode(ends))
        .groupBy(*keys, F.col("_end.t").alias("t"))
        .agg(*[F.sum(F.col(n) * F.col("_end._sign")).alias(n) for n in names], F.sum("_end._sign").alias("_live"))
    )
    summed = [*names, "_live"]
    cut = ranges(changes, keys, "t")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        cut.groupBy(*keys, "_part")
        .agg(F.min("t").alias("_t0"), *[F.sum(n).alias(f"_{n}") for n in summed])
        .withColumns(
            {
                **{f"_{n}": F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in summed},
                "_t0": F.lead("_t0").over(Window.partitionBy(*keys).orderBy("_part")),
            }
        )
    )
    within = Window.partitionBy(*keys, "_part").orderBy("t")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = join_null_safe(cut, parts, [*keys, "_part"]).withColumns(
        {
            **{n: F.col(f"_{n}") + F.sum(n).over(upto) for n in summed},
            "_until": F.coalesce(F.lead("t").over(within), "_t0"),
        }
    )
    times = F.sequence(F.col("t"), F.col("_until") - step, F.lit(step))
    found = list(names) if value is None else [value.alias("value")]
    changed = running.filter("_live > 0").select(*keys, times.alias("_times"), *found)
    return changed.select(*keys, F.explode("_times").alias("t"), *(names if value is None else ["value"]))


def request_rate(requests: DataFrame, range_seconds: int = 60, step_seconds: int = 5) -> DataFrame:
    """Requests per second by status over a sliding range."""
    panes = _panes(requests, ["status"], [F.count(F.lit(1)).alias("n")], step_seconds)
    slid = _sliding(panes, ["status"], ["n"], range_seconds, step_seconds, F.col("n") / range_seconds)
    return slid.withColumnRenamed("value", "rate")


def invalid_rate(attempts: DataFrame, range_seconds: int = 300, step_seconds: int = 5) -> DataFrame:
    """Invalid outputs per second over a sliding range (boolean ``invalid``)."""
    panes = _panes(attempts, [], [F.count_if("invalid").alias("n")], step_seconds).withColumn("_one", F.lit(1))
    slid = _sliding(panes, ["_one"], ["n"], range_seconds, step_seconds, F.col("n") / range_seconds)
    return slid.select("t", F.col("value").alias("rate"))


def bucket_quantile(counts: Column, q: float) -> Column:
    """Quantile by linear interpolation inside cumulative bucket counts."""
    bounds = F.array(*[F.lit(b) for b in LATENCY_BOUNDS])
    total = counts[len(LATENCY_BOUNDS) - 1]
    rank = total * q
    # Position (0-based) of the first bucket that reaches the rank.
    at = F.size(F.filter(counts, lambda c: c < rank))
    below_bound = F.when(at == 0, 0.0).otherwise(F.get(bounds, at - 1))
    below_count = F.when(at == 0, F.lit(0)).otherwise(F.get(counts, at - 1))
    inside = F.get(counts, at) - below_count
    value = below_bound + (F.get(bounds, at) - below_bound) * safe_ratio(
        rank - below_count, inside
    )
    last = len(LATENCY_BOUNDS) - 1
    return F.when(total > 0, F.when(at == last, F.lit(LATENCY_BOUNDS[-2])).otherwise(value))


def latency_quantile(
    requests: DataFrame, q: float = 0.95, range_seconds: int = 300, step_seconds: int = 5
) -> DataFrame:
    """Bucket-interpolated latency quantile per endpoint over a sliding range."""
    panes = _panes(
        requests, ["endpoint"], _bucket_counts(F.col("latency_ms") / 1000), step_seconds
    )
    names = [f"_le{i}" for i in range(len(LATENCY_BOUNDS))]
    slid = _sliding(panes, ["endpoint"], names, range_seconds, step_seconds, bucket_quantile(_bucket_array(), q))
    return slid.withColumnRenamed("value", "latency_seconds")


def rounded_latency(ms: Column) -> Column:
    """Two leading digits beyond 100 ms, as load-test tables keep them.

    This bounds the number of distinct values, so exact percentiles of the
    table come from a small histogram instead of a sort of all rows.
    """
    return (
        F.when(ms < 100, F.bround(ms, 0))
        .when(ms < 1000, F.bround(ms, -1))
        .when(ms < 10000, F.bround(ms, -2))
        .otherwise(F.bround(ms, -3))
        .cast("long")
    )


def latency_table(requests: DataFrame, keys: Sequence[str] = ("type", "name")) -> DataFrame:
    """Load table: one row per key tuple plus an ``Aggregated`` total.

    ``requests``: keys, ``ts``, ``latency_ms``, boolean ``failed``.
    """
    keys = list(keys)
    ms = F.col("latency_ms")
    histogram = requests.groupBy(*keys, rounded_latency(ms).alias("v")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("failed").alias("failures"),
        F.sum(ms).alias("total_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.min(F.unix_micros("ts")).alias("t0"),
        F.max(F.unix_micros("ts")).alias("t1"),
    )
    # The histogram has a few hundred rows per key tuple. Each row counts for
    # its own tuple and for the grand total.
    total_key = F.struct(
        *[F.lit("Aggregated" if k == keys[-1] else "").alias(k) for k in keys]
    )
    own_key = F.struct(*[F.col(k).cast("string").alias(k) for k in keys])
    both = histogram.withColumn("_k", F.explode(F.array(own_key, total_key)))
    values = both.groupBy("_k", "v").agg(
        *[F.sum(c).alias(c) for c in ("n", "failures", "total_ms")],
        *[F.min(c).alias(c) for c in ("min_ms", "t0")],
        *[F.max(c).alias(c) for c in ("max_ms", "t1")],
    )
    upto = (
        Window.partitionBy("_k").orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    whole = Window.partitionBy("_k")
    ranked = (
        values.withColumn("_cum", F.sum("n").over(upto))
        .withColumn("_below", F.col("_cum") - F.col("n"))
        .withColumn("_n", F.sum("n").over(whole))
    )
    table = ranked.groupBy("_k").agg(
        F.sum("n").alias("request_count"),
        F.sum("failures").alias("failure_count"),
        F.min(F.when(F.col("_cum") > (F.col("_n") - 1) / 2, F.col("v"))).alias("median_ms"),
        F.sum("total_ms").alias("_total"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        F.min("t0").alias("_t0"),
        F.max("t1").alias("_t1"),
        *[
            F.max(F.when(F.col("_below") <= F.floor(F.col("_n") * p), F.col("v"))).alias(
                percentile_name(p)
            )
            for p in PERCENTILES
        ],
    )
    # Rates are over the span of the whole run: one row per key tuple here.
    run = Window.partitionBy(F.lit(1))
    span = (F.max("_t1").over(run) - F.min("_t0").over(run)) / 1e6
    return table.withColumn("_span", span).select(
        *[F.col(f"_k.{k}").alias(k) for k in keys],
        "request_count",
        "failure_count",
        "median_ms",
        (F.col("_total") / F.col("request_count")).alias("mean_ms"),
        "min_ms",
        "max_ms",
        safe_ratio(F.col("request_count"), F.col("_span")).alias("requests_per_s"),
        safe_ratio(F.col("failure_count"), F.col("_span")).alias("failures_per_s"),
        *[percentile_name(p) for p in PERCENTILES],
    )


def percentile_name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")
