import hashlib

from pyspark.sql import functions as F

from callsieve.operators.dedup import keep_new
from callsieve.sources.digests import file_block_digests, folded_digests


def test_equal_to_plain_reading(spark, tmp_path):
    block = 1000
    contents = {"a.bin": bytes(range(256)) * 20, "empty": b"", "one": b"x" * 1000, "two": b"x" * 1001}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in folded_digests(file_block_digests(spark, f"file://{tmp_path}", block)).collect()}
    want = {}
    for name, data in contents.items():
        parts = [hashlib.sha256(data[i : i + block]).digest() for i in range(0, max(1, len(data)), block)]
        want[name] = (len(data), parts[0].hex() if len(parts) == 1 else hashlib.sha256(b"".join(parts)).hexdigest())
    assert got == want
    assert file_block_digests(spark, f"file://{tmp_path}/one").count() == 1


def test_later_drop_against_earlier_ones(spark, folder):
    spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(0).alias("drop")).write.partitionBy("drop").parquet(f"{folder}/seen")
    batch = spark.createDataFrame([(0, "k1"), (1, "new"), (2, "new"), (3, None), (4, "k1999")], "ordinal long, key string")
    got = keep_new(batch, "key", spark.read.parquet(f"{folder}/seen"))
    assert sorted((r.ordinal, r.key) for r in got.collect()) == [(1, "new"), (3, None)]


def test_history_is_filtered_before_its_shuffle(spark, folder):
    """Where history is large: a Bloom filter of the drop's keys at the scan of history."""
    spark.range(5000).select(F.col("id").cast("string").alias("key")).write.parquet(f"{folder}/seen")
    spark.range(5000).select(F.col("id").alias("ordinal"), (F.col("id") + 4990).cast("string").alias("key"), (F.col("id") % 7).alias("kind")).write.parquet(f"{folder}/drop")
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        drop = spark.read.parquet(f"{folder}/drop").filter("kind = 3")
        found = keep_new(drop, "key", spark.read.parquet(f"{folder}/seen"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "might_contain" in plan
        assert found.count() == drop.filter("cast(key as long) >= 5000").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
