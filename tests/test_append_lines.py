import random

from callsieve.sources import tail as T


def test_appends_in_order_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small input, still many parts
    rng = random.Random(5)
    rows = [(i % 3, i, "x" * rng.choice([0, 1, 5, 30]) + rng.choice(["", "é", "\U0001f600"])) for i in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "third int, n int, value string").repartition(5)
    path = f"file://{tmp_path}/grown.jsonl"
    want = b""
    for k in range(3):
        added = frame.filter(f"third = {k}")
        parts = T.append_lines(spark, added, ["third", "n"], path)
        assert parts > 1  # not written by one task
        want += b"".join(v.encode() + b"\n" for _, _, v in sorted(r for r in rows if r[0] == k))
        assert (tmp_path / "grown.jsonl").read_bytes() == want
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stores_that_tasks_cannot_write_into(spark):
    frame = spark.createDataFrame([(1, "a")], "n int, value string")
    assert T.append_lines(spark, frame, ["n"], "nowhere://x/y.jsonl") is None
