"""The stored feature table: hash buckets of the key inside each version, and a manifest.

Rows lie in ``data/dataset_version=V/bucket=K/snap=S``. The manifest names the one folder
that counts for each version and bucket; a reader opens those and no others. An upsert
reads and writes the buckets that its keys fall in, then swaps the manifest by one
rename: until then, and if it never happens, readers have the old snapshot.
One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsieve.operators.features import upsert_features
from callsieve.schemas import FEATURES
from callsieve.session import fresh_dir, path_exists, remove_path, scratch

#: Rows that a bucket should hold of the first batch, and bounds of the number of buckets.
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 16
MANIFEST = "MANIFEST"
_COLUMNS = [f.name for f in FEATURES.fields]
_STORED = T.StructType([*FEATURES.fields, T.StructField("bucket", T.IntegerType()), T.StructField("snap", T.StringType())])


class Manifest(NamedTuple):
    """Number of buckets, and the folders (below ``data``) that count, by version and bucket."""

    buckets: int
    folders: dict[str, str]


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    target, files = _file(spark, f"{path}/{MANIFEST}")
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _swap_manifest(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Write the manifest beside the present one and rename it over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, files = _file(spark, f"{path}/{MANIFEST}-{uuid.uuid4().hex}")
    out = files.create(new)
    try:
        out.write(bytearray(json.dumps(manifest._asdict()).encode()))
    finally:
        out.close()
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    context.rename(files.makeQualified(new), files.makeQualified(_file(spark, f"{path}/{MANIFEST}")[0]), over)


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], _STORED)
    reader = spark.read.schema(_STORED).option("basePath", f"{path}/data")
    return reader.parquet(*[f"{path}/data/{f}" for f in folders])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the present snapshot; a filter on ``dataset_version`` opens that version only."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise ValueError(f"no feature table at {path}")
    return _rows(spark, path, sorted(manifest.folders.values())).select(*_COLUMNS)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")


def upsert(features: DataFrame, path: str) -> None:
    """Replace or add rows by ``(entity_id, dataset_version)``; of ``features`` each key has one row.

    The batch is written to the shared folder once; only its versions and buckets are read from
    the table and written anew. The number of buckets is that of the first batch.
    """
    spark = features.sparkSession
    with scratch(spark):
        staged = fresh_dir(spark, "feature-batch")
        features.select(*_COLUMNS).write.parquet(staged)
        batch = spark.read.schema(FEATURES).parquet(staged)
        manifest = read_manifest(spark, path)
        if manifest is None:
            wanted = -(-batch.count() // BUCKET_ROWS)
            manifest = Manifest(min(MOST_BUCKETS, max(LEAST_BUCKETS, wanted)), {})
        batch = batch.withColumn("bucket", _bucket(manifest.buckets))
        touched: dict[str, list[int]] = {}
        for r in batch.select("dataset_version", "bucket").distinct().collect():
            touched.setdefault(r.dataset_version, []).append(r.bucket)
        if not touched:
            return
        stored = _rows(spark, path, sorted(manifest.folders.values()))
        these = F.lit(False)
        for version, buckets in touched.items():
            these = these | ((F.col("dataset_version") == version) & F.col("bucket").isin(buckets))
        merged = upsert_features(stored.filter(these).select(*_COLUMNS), batch.withColumn("ordinal", F.lit(0).cast("long")))
        snap = uuid.uuid4().hex
        (
            merged.withColumns({"bucket": _bucket(manifest.buckets), "snap": F.lit(snap)})
            .repartition("dataset_version", "bucket")
            .write.mode("append")
            .partitionBy("dataset_version", "bucket", "snap")
            .parquet(f"{path}/data")
        )
        data, files = _file(spark, f"{path}/data")
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/dataset_version=*/bucket=*/snap={snap}"))
        folders = dict(manifest.folders)
        for status in found:
            leaf = status.getPath()
            place = f"{leaf.getParent().getParent().getName()}/{leaf.getParent().getName()}"
            folders[place] = f"{place}/{leaf.getName()}"
        _swap_manifest(spark, path, Manifest(manifest.buckets, folders))


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove folders that no longer count, once no reader has an older snapshot open; their number."""
    manifest = read_manifest(spark, path)
    if manifest is None or not path_exists(spark, f"{path}/data"):
        return 0
    _, files = _file(spark, path)
    kept, gone = set(manifest.folders.values()), 0
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/dataset_version=*/bucket=*/snap=*")):
        leaf = status.getPath()
        bucket = leaf.getParent()
        if f"{bucket.getParent().getName()}/{bucket.getName()}/{leaf.getName()}" not in kept:
            remove_path(spark, leaf.toString())
            gone += 1
    return gone
