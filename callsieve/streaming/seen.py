"""Event ids of all earlier batches, so that a batch opens little of them.

Ids lie in runs: one for each batch, and one for each ``FAN`` runs that have been merged, so that
there are few runs however long a stream has been going. A run is dealt in hash buckets, and has a
Bloom filter for each. A batch looks its ids up in the filters, which take two bytes
an id, and opens only the buckets that may hold one: as a rule those of true repeats.

A run is written before its batch is committed and overwritten when the batch is run again. Where
a run is missing (a store from before, or a replay after its merge) there is no answer, and the
caller scans the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.session import path_exists, remove_path

FAN, BUCKETS = 8, 64
BITS, PROBES = 16, 4
_BLOOM = "bucket int, word long, bits long, width long"


def _ids(root: str, name: str) -> str:
    return f"{root}/ids/run={name}"


def _blooms(root: str, name: str) -> str:
    return f"{root}/blooms/run={name}"


def _stored(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    reader = spark.read.schema("event_id string, run string, bucket int").option("basePath", f"{root}/ids")
    return reader.parquet(*folders).select("event_id")


def _there(spark: SparkSession, root: str, name: str) -> bool:
    return path_exists(spark, f"{_blooms(root, name)}/_SUCCESS")


def live_runs(spark: SparkSession, root: str, batch_id: int) -> list[str] | None:
    """The runs that hold the ids of all batches before ``batch_id``, None if one is missing."""

    def cover(level: int, start: int) -> list[str] | None:
        if _there(spark, root, f"{level}-{start}"):
            return [f"{level}-{start}"]
        if not level:
            return None
        size = FAN ** (level - 1)
        parts = [cover(level - 1, start + k * size) for k in range(FAN)]
        return None if None in parts else [name for part in parts for name in part]

    found: list[str] = []
    at = 0
    while at < batch_id:
        level = 0
        while at % FAN ** (level + 1) == 0 and at + FAN ** (level + 1) <= batch_id:
            level += 1
        part = cover(level, at)
        if part is None:
            return None
        found += part
        at += FAN**level
    return found


def _bucket() -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int")


def _probes(width: Column) -> Column:
    """Places of an id's bits in a filter of ``width`` words of 64."""
    first, step = F.xxhash64(F.lit(1), "event_id"), F.xxhash64(F.lit(2), "event_id")
    return F.array(*[F.pmod(F.pmod(first, width * 64) + k * F.pmod(step, width * 64), width * 64) for k in range(PROBES)])


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def _write_run(ids: DataFrame, root: str, name: str) -> None:
    spark = ids.sparkSession
    path = _ids(root, name)
    ids.select("event_id", _bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    stored = spark.read.schema("event_id string, bucket int").parquet(path)
    width = max(1, -(-stored.count() * BITS // (64 * BUCKETS)))
    words = (
        stored.select("bucket", F.explode(_probes(F.lit(width))).alias("place"))
        .groupBy("bucket", F.floor(F.col("place") / 64).alias("word"))
        .agg(F.bit_or(_bit(F.col("place"))).alias("bits"))
    )
    words.withColumn("width", F.lit(width).cast("long")).repartition(1).write.mode("overwrite").parquet(_blooms(root, name))


def add(ids: DataFrame, root: str, batch_id: int) -> None:
    """Note the accepted ids of a batch."""
    _write_run(ids, root, f"0-{batch_id}")


def merge(spark: SparkSession, root: str, batch_id: int) -> None:
    """Merge the runs that batch ``batch_id - 1`` has completed; what they were made of goes."""
    level = 1
    while batch_id and batch_id % FAN**level == 0:
        size = FAN ** (level - 1)
        start = batch_id - FAN**level
        parts = [f"{level - 1}-{start + k * size}" for k in range(FAN)]
        if not _there(spark, root, f"{level}-{start}"):
            if not all(_there(spark, root, p) for p in parts):
                return
            _write_run(_stored(spark, root, [_ids(root, p) for p in parts]), root, f"{level}-{start}")
        for p in parts:
            remove_path(spark, _blooms(root, p))
            remove_path(spark, _ids(root, p))
        level += 1


def may_hold(ids: DataFrame, root: str, runs: list[str]) -> list[str]:
    """Folders of the buckets that may hold one of ``ids (event_id)``."""
    spark = ids.sparkSession
    if not runs:
        return []
    reader = spark.read.schema(f"{_BLOOM}, run string").option("basePath", f"{root}/blooms")
    blooms = reader.parquet(*[_blooms(root, r) for r in runs])
    widths = blooms.select("run", "width").distinct().collect()
    if not widths:
        return []
    known = F.array(*[F.struct(F.lit(r.run).alias("run"), F.lit(r.width).alias("width")) for r in widths])
    asked = (
        ids.select("event_id", _bucket().alias("bucket"), F.explode(known).alias("in"))
        .select("event_id", "bucket", "in.run", F.explode(_probes(F.col("in.width"))).alias("place"))
        .withColumn("word", F.floor(F.col("place") / 64))
    )
    hits = (
        asked.join(blooms.select("run", "bucket", "word", "bits"), ["run", "bucket", "word"])
        .filter(F.col("bits").bitwiseAND(_bit(F.col("place"))) != 0)
        .groupBy("run", "bucket", "event_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == PROBES)
        .select("run", "bucket")
        .distinct()
    )
    return sorted(f"{_ids(root, r.run)}/bucket={r.bucket}" for r in hits.collect())


def history_of(ids: DataFrame, root: str, batch_id: int) -> DataFrame | None:
    """Ids of earlier batches among which all repeats of ``ids`` are, None if runs are missing."""
    spark = ids.sparkSession
    runs = live_runs(spark, root, batch_id)
    if runs is None:
        return None
    folders = may_hold(ids, root, runs)
    if not folders:
        return spark.createDataFrame([], "event_id string")
    return _stored(spark, root, folders)
