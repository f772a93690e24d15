import pytest
from pyspark.sql import functions as F

from callsieve.operators import features as X
from callsieve.sources import feature_table as table
from callsieve.sources import sinks
from callsieve.sources.files import read_features


def rows(spark, *data):
    df = spark.createDataFrame(list(data), "row_idx long, transcript string, split string, is_fraud boolean")
    return X.extract_features(df, "v1", "fixture", "2026-01-01")


def test_later_split_then_later_line_wins(spark):
    f = rows(spark, (5, "same text", "train", True), (0, "same  text", "test", False), (9, "same text", "val", True))
    r = X.latest_features(f).collect()
    assert len(r) == 1 and (r[0].split, r[0].is_fraud, r[0].char_count) == ("test", 0, 10)


def test_upsert_replaces_and_adds(spark):
    old = X.latest_features(rows(spark, (0, "a", "train", False), (1, "b", "train", False)))
    new = X.upsert_features(old, rows(spark, (0, "b", "test", True), (1, "c", "val", False)))
    assert new.columns == old.columns
    assert sorted((r.split, r.is_fraud) for r in new.collect()) == [("test", 1), ("train", 0), ("val", 0)]


def test_write_is_idempotent_and_keeps_other_versions(spark, folder):
    f = X.latest_features(rows(spark, (0, "ring 30 bells", "test", True), (1, "quiet evening", "test", False)))
    other = f.withColumn("dataset_version", F.lit("v0"))
    for frame in (other, f, f):
        sinks.write_features(frame, f"{folder}/store")
    stored = read_features(spark, f"{folder}/store")
    assert stored.count() == 4
    t = X.feature_totals(X.feature_lookup(stored, "v1")).first()
    assert (t.fraud_rows, t.rows) == (1, 2)
    plan = X.feature_lookup(stored, "v1", "test", True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_version" in plan
    assert "PushedFilters: [IsNotNull(split), IsNotNull(is_fraud)" in plan


def test_report_counts_rows_and_keys(spark):
    f = rows(spark, (0, "x", "train", True), (1, "x", "test", True), (2, "y", "val", False))
    r = X.materialize_report(f).first()
    assert (r.materialized_rows, r.stored_rows, r.train_rows, r.val_rows, r.test_rows) == (3, 2, 1, 1, 1)


def test_partial_batches_keep_the_rest(spark, folder):
    path = f"{folder}/store"
    sinks.write_features(X.latest_features(rows(spark, (0, "a", "train", False), (1, "b", "train", False), (2, "c", "val", False))), path)
    sinks.write_features(X.latest_features(rows(spark, (0, "b", "test", True), (1, "d", "train", True))), path)
    got = sorted((r.split, r.is_fraud) for r in read_features(spark, path).collect())
    assert got == [("test", 1), ("train", 0), ("train", 1), ("val", 0)]


def many(spark, ids, split="train"):
    return X.latest_features(rows(spark, *[(i, f"text number {i}", split, False) for i in ids]))


def test_one_key_rewrites_one_bucket(spark, folder):
    path = f"{folder}/store"
    sinks.write_features(many(spark, range(100)), path)
    before = table.read_manifest(spark, path)
    assert before.buckets == table.LEAST_BUCKETS == len(before.folders)
    sinks.write_features(many(spark, [7], "test"), path)
    after = table.read_manifest(spark, path)
    assert sum(before.folders[k] != after.folders[k] for k in before.folders) == 1
    stored = read_features(spark, path)
    assert stored.count() == 100 and stored.filter("split = 'test'").count() == 1
    assert table.vacuum(spark, path) == 1 and table.vacuum(spark, path) == 0
    assert read_features(spark, path).count() == 100


def test_crash_before_the_rename_leaves_the_old_snapshot(spark, folder, monkeypatch):
    path = f"{folder}/store"
    sinks.write_features(many(spark, range(20)), path)
    open_before = read_features(spark, path)
    with monkeypatch.context() as m:
        m.setattr(table, "_swap_manifest", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.write_features(many(spark, range(40), "test"), path)
    assert read_features(spark, path).filter("split = 'train'").count() == read_features(spark, path).count() == 20
    sinks.write_features(many(spark, range(40), "test"), path)
    assert read_features(spark, path).filter("split = 'test'").count() == 40
    assert open_before.filter("split = 'train'").count() == 20  # a reader keeps what it opened
    assert table.vacuum(spark, path) > 0 and read_features(spark, path).count() == 40


def test_odd_version_names_and_empty_batches(spark, folder):
    path = f"{folder}/store"
    for version in ("a/b=c", "2026-01-01", "1", "x y%"):
        sinks.write_features(many(spark, range(5)).withColumn("dataset_version", F.lit(version)), path)
    sinks.write_features(many(spark, range(5)).limit(0), path)
    assert {r.dataset_version: r.n for r in read_features(spark, path).groupBy("dataset_version").agg(F.count("*").alias("n")).collect()} == {
        "a/b=c": 5, "2026-01-01": 5, "1": 5, "x y%": 5
    }
    with pytest.raises(ValueError):
        read_features(spark, f"{folder}/nothing")


def test_constraints(spark, folder):
    good = X.latest_features(rows(spark, (0, "a", "train", False)))
    for bad in ({"split": F.lit("exam")}, {"turn_count": F.lit(0)}, {"digit_ratio": F.lit(1.5)}, {"has_url": F.lit(None).cast("int")}):
        with pytest.raises(Exception, match="breaks its constraint"):
            sinks.write_features(good.withColumns(bad), f"{folder}/s")
