import hashlib
import math

import pytest
from pyspark.sql import functions as F

from callsieve.operators import split as S
from callsieve.schemas import SplitPolicy


def rows(spark, n, fraud):
    return spark.range(n).select(F.col("id").alias("row_key"), (F.col("id") < fraud).alias("is_fraud"))


@pytest.mark.parametrize("n,fraud,sizes", [(9000, 4500, (6749, 901, 1350)), (1600, 800, (1199, 161, 240))])
def test_published_sizes(spark, n, fraud, sizes):
    got = {r.split: (r.n, r.f) for r in S.stratified_split(rows(spark, n, fraud)).groupBy("split").agg(
        F.count("*").alias("n"), F.avg(F.col("is_fraud").cast("int")).alias("f")).collect()}
    assert tuple(got[s][0] for s in ("train", "val", "test")) == sizes
    assert all(abs(f - 0.5) < 0.004 for _, f in got.values())


def test_membership_is_that_of_a_full_sort(spark):
    got = {r.row_key: r.split for r in S.stratified_split(rows(spark, 500, 130)).collect()}
    quota = {q.is_fraud: (q.test_q, q.val_q) for q in S.split_quotas(
        spark.createDataFrame([(True, 130), (False, 370)], "is_fraud boolean, c long")).collect()}
    assert sum(t for t, _ in quota.values()) == math.ceil(500 * 0.15)
    for label in (True, False):
        keys = [k for k in range(500) if (k < 130) == label]
        keys.sort(key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())
        t, v = quota[label]
        for i, k in enumerate(keys):
            assert got[k] == ("test" if i < t else "val" if i < t + v else "train")


def test_seed_changes_members_not_sizes(spark):
    a = S.stratified_split(rows(spark, 400, 100))
    b = S.stratified_split(rows(spark, 400, 100), policy=SplitPolicy(seed=7))
    count = lambda d: {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert count(a) == count(b)
    assert a.join(b, ["row_key", "split"]).count() < 400


def test_tiny_and_one_sided_inputs(spark):
    assert S.stratified_split(rows(spark, 3, 3)).count() == 3
    assert S.stratified_split(rows(spark, 0, 0)).count() == 0
    assert {r.split for r in S.assign_splits(rows(spark, 5, 2), eval_only=True).collect()} == {"test"}


def test_threshold_variant_is_close(spark):
    got = {r["split"]: r["count"] for r in S.threshold_split(rows(spark, 20000, 100)).groupBy("split").count().collect()}
    assert abs(got["test"] / 20000 - 0.15) < 0.02 and abs(got["val"] / 20000 - 0.10) < 0.02


def test_manifest_and_version_depend_on_content_only(spark):
    df = S.stratified_split(rows(spark, 300, 90))
    make = lambda d, when: S.split_manifest(d, "calls", checksum_columns=("row_key", "is_fraud"), generated_at=when)
    a, b = make(df, "2026-01-01"), make(df.repartition(3).orderBy(F.rand()), "2027-01-01")
    version = lambda m: S.dataset_version(m).first().dataset_version
    assert version(a) == version(b)
    assert version(a) != version(make(df.filter("row_key <> 7"), None))
    row = a.filter("split = 'test'").first()
    assert row.n == 45 and row.config_snapshot.seed == 42
    assert S.split_overlap(df.withColumn("fingerprint", F.col("row_key").cast("string"))).count() == 0


def test_ratio_of_nothing_is_zero(spark):
    assert rows(spark, 0, 0).agg(S.fraud_ratio(F.col("is_fraud")).alias("r")).first().r == 0.0


def test_file_digest(spark, tmp_path, folder):
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = S.file_digests(spark.read.format("binaryFile").load(f"{folder}/a.bin")).first()
    assert (r.length, r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
