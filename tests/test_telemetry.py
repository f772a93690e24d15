import pytest
from pyspark.sql import functions as F

from callsieve.operators import telemetry as T


def requests(spark, data):
    return spark.createDataFrame(data, "sec long, name string, latency_ms double, status int").select(
        F.timestamp_seconds("sec").alias("ts"), F.lit("GET").alias("type"), "name", F.col("name").alias("endpoint"),
        "latency_ms", "status", (F.col("status") >= 500).alias("failed"), (F.col("status") == 503).alias("invalid"),
    )


def test_load_table_has_leaf_rows_and_a_total(spark):
    df = requests(spark, [(0, "/a", float(m), 200) for m in range(1, 101)] + [(10, "/b", 1234.0, 503)])
    got = {r.name: r for r in T.latency_table(df).collect()}
    a, b, total = got["/a"], got["/b"], got["Aggregated"]
    assert total.type == "" and (total.request_count, total.failure_count) == (101, 1)
    assert (a.median_ms, a.p50, a.p95, a.p99, a.p100) == (50, 51, 96, 100, 100)
    assert (a.mean_ms, a.min_ms, a.max_ms, a.requests_per_s) == (50.5, 1.0, 100.0, 10.0)
    assert (b.p50, b.failures_per_s, total.p100) == (1200, 0.1, 1200)


def test_histogram_and_counts(spark):
    df = requests(spark, [(0, "/a", 4.0, 200), (0, "/a", 5.0, 200), (0, "/a", 20000.0, 503)])
    h = {r.le: r.requests for r in T.latency_histogram(df).collect()}
    assert (h[0.005], h[0.01], h[10.0], h[float("inf")]) == (2, 2, 2, 3)
    assert {(r.endpoint, r.status): r.requests for r in T.request_counts(df).collect()} == {("/a", 200): 2, ("/a", 503): 1}


@pytest.mark.parametrize(
    "latencies,q,expected",
    [([4.0] * 10, 0.5, 0.0025), ([4.0] * 5 + [7.0] * 5, 0.75, 0.0075), ([20000.0] * 3, 0.95, 10.0)],
)
def test_quantile_interpolates_inside_its_bucket(spark, latencies, q, expected):
    df = requests(spark, [(0, "/a", x, 200) for x in latencies])
    r = T.latency_quantile(df, q, 10, 5).filter("t = 5").first()
    assert r.latency_seconds == pytest.approx(expected)


def test_sliding_rate_equals_counting_each_range(spark):
    seconds = [0, 1, 4, 5, 5, 17, 59, 60]
    df = requests(spark, [(s, "/a", 1.0, 200) for s in seconds])
    got = {r.t: r.rate for r in T.request_rate(df, 20, 5).collect()}
    for t, rate in got.items():
        assert rate == sum(t - 20 <= s < t for s in seconds) / 20
    assert sum(got.values()) * 20 == len(seconds) * 4
    inv = T.invalid_rate(requests(spark, [(0, "/a", 1.0, 503), (1, "/a", 1.0, 200)]), 10, 5).collect()
    assert {r.rate for r in inv} == {0.1}
