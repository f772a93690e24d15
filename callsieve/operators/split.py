"""Exact stratified split, manifest, and build checks.

Ranking every stratum with a window would put half of all rows into one task.
Instead the seeded hash of a row is cut into ``2**16`` buckets. Bucket counts
(a bounded table) tell in which bucket each quota ends; only rows of those few
buckets are ranked, and the exact cut points come back as a handful of values.
The rows themselves are labelled by comparison and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.functions.verdict import is_fraud
from callsieve.schemas import SPLITS, SplitPolicy

_BUCKET_HEX = 4  # leading hex digits of the hash: 65,536 buckets


def split_hash(key: Column, seed: int) -> Column:
    """Seeded ordering hash of a row key, lower-case hex."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def split_quotas(stratum_counts: DataFrame, policy: SplitPolicy = SplitPolicy()) -> DataFrame:
    """``(is_fraud, c, test_q, val_q)`` from ``(is_fraud, c)``; at most 2 rows.

    Sizes are ``ceil`` of the shares; each size is spread over the strata by
    largest remainder, ties to the lower stratum.
    """
    val_share = policy.val_size / (1.0 - policy.test_size)
    everything = Window.partitionBy(F.lit(1))

    def spread(size: Column, weight: Column, total: Column, name: str, df: DataFrame) -> DataFrame:
        exact = size * weight / total
        df = df.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
        order = Window.partitionBy(F.lit(1)).orderBy(F.col("_rest").desc(), F.col("is_fraud"))
        extra = size - F.sum("_floor").over(everything)
        return df.withColumn(
            name,
            F.col("_floor") + F.when(F.row_number().over(order) <= extra, 1).otherwise(0),
        ).drop("_floor", "_rest")

    df = stratum_counts.withColumn("_n", F.sum("c").over(everything)).withColumn(
        "_test", F.ceil(F.col("_n") * policy.test_size)
    )
    df = spread(F.col("_n") - F.col("_test"), F.col("c"), F.col("_n"), "_rest_q", df)
    df = df.withColumn("test_q", F.col("c") - F.col("_rest_q"))
    df = df.withColumn("_rest_n", F.col("_n") - F.col("_test")).withColumn(
        "_val", F.ceil(F.col("_rest_n") * val_share)
    )
    df = spread(F.col("_rest_n") - F.col("_val"), F.col("_rest_q"), F.col("_rest_n"), "_train_q", df)
    return df.select("is_fraud", "c", "test_q", (F.col("_rest_q") - F.col("_train_q")).alias("val_q"))


def stratified_split(
    df: DataFrame, key: str = "row_key", policy: SplitPolicy = SplitPolicy()
) -> DataFrame:
    """Add ``split`` (train/val/test) with exact per-stratum sizes.

    ``df`` needs a boolean ``is_fraud`` and a unique ``key``.
    """
    hashed = df.withColumn("_h", split_hash(F.col(key), policy.seed))
    slim = hashed.select(
        "is_fraud", F.col("_h"), F.substring("_h", 1, _BUCKET_HEX).alias("_bucket")
    )
    # At most 2 strata x 65,536 buckets, whatever the size of the data.
    buckets = slim.groupBy("is_fraud", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = (
        Window.partitionBy("is_fraud").orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = buckets.withColumn("_end", F.sum("_n").over(upto)).withColumn(
        "_begin", F.col("_end") - F.col("_n")
    )
    quotas = split_quotas(
        buckets.groupBy("is_fraud").agg(F.sum("_n").alias("c")), policy
    )
    # Two cuts per stratum: the last test row and the last validation row.
    cuts = quotas.select(
        "is_fraud",
        F.explode(
            F.array(
                F.struct(F.lit("test_cut").alias("cut"), F.col("test_q").alias("rank")),
                F.struct(
                    F.lit("val_cut").alias("cut"), (F.col("test_q") + F.col("val_q")).alias("rank")
                ),
            )
        ).alias("c"),
    ).select("is_fraud", "c.cut", "c.rank")
    at = (
        cuts.join(running, "is_fraud")
        .filter((F.col("rank") > F.col("_begin")) & (F.col("rank") <= F.col("_end")))
        .select("is_fraud", "_bucket", "cut", (F.col("rank") - F.col("_begin")).alias("_k"))
    )
    # Rows of at most four buckets, about n / 65,536 each.
    place = Window.partitionBy("is_fraud", "_bucket").orderBy("_h")
    edge = (
        slim.join(F.broadcast(at.select("is_fraud", "_bucket").distinct()), ["is_fraud", "_bucket"])
        .withColumn("_k", F.row_number().over(place))
        .join(F.broadcast(at), ["is_fraud", "_bucket", "_k"])
        .groupBy("is_fraud")
        .agg(
            F.max(F.when(F.col("cut") == "test_cut", F.col("_h"))).alias("_test_cut"),
            F.max(F.when(F.col("cut") == "val_cut", F.col("_h"))).alias("_val_cut"),
        )
    )
    h = F.col("_h")
    return (
        hashed.join(F.broadcast(edge), "is_fraud", "left")
        .withColumn(
            "split",
            F.when(h <= F.col("_test_cut"), "test")
            .when(h <= F.col("_val_cut"), "val")
            .otherwise("train"),
        )
        .drop("_h", "_test_cut", "_val_cut")
    )


def threshold_split(
    df: DataFrame, key: str = "row_key", policy: SplitPolicy = SplitPolicy()
) -> DataFrame:
    """One-pass variant: sizes hold within sampling error, no pre-counts.

    For streams of arrivals whose total is not known when a row is labelled.
    """
    lead = F.conv(F.substring(split_hash(F.col(key), policy.seed), 1, 12), 16, 10).cast("double")
    share = lead / F.lit(float(16**12))
    return df.withColumn(
        "split",
        F.when(share < policy.test_size, "test")
        .when(share < policy.test_size + policy.val_size, "val")
        .otherwise("train"),
    )


def assign_splits(
    df: DataFrame,
    key: str = "row_key",
    policy: SplitPolicy = SplitPolicy(),
    eval_only: bool = False,
) -> DataFrame:
    """Split a dataset; an evaluation-only one is all ``test``."""
    if eval_only:
        return df.withColumn("split", F.lit("test"))
    return stratified_split(df, key, policy)


def content_checksum(*columns: str) -> tuple[Column, Column]:
    """Order-independent checksum parts: sum and xor of row hashes."""
    h = F.xxhash64(*columns)
    return (
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    )


def split_manifest(
    df: DataFrame,
    dataset: str,
    policy: SplitPolicy = SplitPolicy(),
    checksum_columns: tuple[str, ...] = ("prompt", "completion"),
    generated_at: str | None = None,
    git_commit: str | None = None,
) -> DataFrame:
    """One lineage row per split: size, fraud ratio, checksum, configuration."""
    hash_sum, hash_xor = content_checksum(*checksum_columns)
    return (
        df.groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n"),
            fraud_ratio(F.col("is_fraud")).alias("fraud_ratio"),
            hash_sum,
            hash_xor,
        )
        .select(
            F.lit(dataset).alias("dataset"),
            F.lit(generated_at).cast("string").alias("generated_at"),
            F.lit(git_commit).cast("string").alias("git_commit"),
            F.struct(
                F.lit(policy.test_size).alias("test_size"),
                F.lit(policy.val_size).alias("val_size"),
                F.lit(policy.seed).alias("seed"),
            ).alias("config_snapshot"),
            "split",
            "n",
            "fraud_ratio",
            F.sha2(F.concat_ws(":", "n", "hash_sum", "hash_xor"), 256).alias("checksum"),
        )
    )


def dataset_version(manifest: DataFrame) -> DataFrame:
    """One row ``(dataset, dataset_version)``: a hash of the split checksums.

    Rebuilding the same rows gives the same version; when it was built does
    not enter. A manifest has at most three rows per dataset.
    """
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "split", "checksum")))
    return manifest.groupBy("dataset").agg(
        F.sha2(F.array_join(parts, ","), 256).alias("dataset_version")
    )


def file_digests(binary_files: DataFrame) -> DataFrame:
    """SHA-256 of file bytes, from the ``binaryFile`` source (files < 2 GB)."""
    return binary_files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def fraud_ratio(flag: Column) -> Column:
    """Share of true values, 0 where there are no rows."""
    return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per split and fraud type."""
    return df.groupBy("split", F.col("verdict.fraud_type").alias("fraud_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def split_overlap(df: DataFrame) -> DataFrame:
    """Fingerprints found in more than one split: must be empty.

    Splits are compared by number, which keeps the aggregation hash-based.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    return (
        df.groupBy("fingerprint")
        .agg(F.min(rank).alias("first_split"), F.max(rank).alias("last_split"))
        .filter("first_split <> last_split")
        .select("fingerprint")
    )


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("is_fraud", is_fraud(F.col("verdict.risk")))
