import random

import numpy as np
from pyspark.sql import functions as F

from callsieve.operators.percentiles import exact_percentiles
from callsieve.operators.telemetry import _sliding


def test_equals_numpy(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random() * 1000, float(rng.randrange(5)), None])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        own = [v for x, v in rows if x == k and v is not None]
        for name, q in shares.items():
            assert abs(r[name] - np.quantile(own, q)) < 1e-9, (k, name)
    total = exact_percentiles(df, [], "v", {"p": 0.95}).first()
    assert abs(total.p - np.quantile([v for _, v in rows if v is not None], 0.95)) < 1e-9
    assert exact_percentiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_one_value_holds_most_rows(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5).alias("v"))
    own = [i if i % 3 == 0 else 5 for i in range(10_000)]
    assert abs(exact_percentiles(df, ["k"], "v", {"p": 0.95}).first().p - np.quantile(own, 0.95)) < 1e-9


def test_sliding_sums_equal_expanded_panes(spark):
    rng = random.Random(7)
    panes = {(rng.choice(["a", None]), 5 * rng.randrange(0, 60)): rng.randrange(0, 4) for _ in range(60)} | {("a", 5000): 2}
    df = spark.createDataFrame([(k, p, n) for (k, p), n in panes.items()], "k string, _pane long, n long")
    want = {}
    for (k, p), n in panes.items():
        for t in range(p + 5, p + 60 + 1, 5):
            want[k, t] = want.get((k, t), 0) + n
    usual = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("true", "false"):  # one range of time, and several
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            rows = _sliding(df, ["k"], ["n"], 60, 5).collect()
            assert len(rows) == len(want) and {(r.k, r.t): r.n for r in rows} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", usual)
