"""Feature table: extraction, last-wins upsert, materialisation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.functions.text import fingerprint, text_features
from callsieve.operators.dedup import keep_last_small
from callsieve.operators.ordering import NESTED_BITS, ordinal
from callsieve.schemas import FEATURES, SPLITS

FEATURE_KEYS = ["entity_id", "dataset_version"]


def split_rank(split: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split) - 1


def extract_features(
    df: DataFrame, dataset_version: str | Column, dataset_name: str, generated_at: str | None = None
) -> DataFrame:
    """Feature rows of ``(transcript, split, is_fraud, row_idx)``, plus the order.

    Narrow: only scalars leave this projection.
    """
    version = (
        dataset_version if isinstance(dataset_version, Column) else F.lit(dataset_version)
    )
    text = F.col("transcript")
    values = {
        "entity_id": fingerprint(text),
        "dataset_version": version,
        "dataset_name": F.lit(dataset_name),
        "split": F.col("split"),
        **text_features(text),
        "is_fraud": F.col("is_fraud").cast("int"),
        "generated_at": F.lit(generated_at),
    }
    return df.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in FEATURES.fields],
        ordinal(split_rank(F.col("split")), F.col("row_idx"), NESTED_BITS).alias("ordinal"),
    )


def latest_features(features: DataFrame) -> DataFrame:
    """One row per key: later split, then later line, replaces earlier ones."""
    return keep_last_small(features, FEATURE_KEYS).drop("ordinal")


def upsert_features(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` with the keys of ``incoming`` replaced or added.

    ``stored`` has no ordinal: whatever arrives is newer.
    """
    old = stored.withColumn("ordinal", F.lit(-1).cast("long"))
    both = old.unionByName(incoming.select(*old.columns))
    return keep_last_small(both, FEATURE_KEYS).drop("ordinal")


def materialize_report(features: DataFrame) -> DataFrame:
    """Rows per dataset, split and in all, and how many keys they make."""
    keys = features.groupBy("dataset_name", "dataset_version", "entity_id").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS],
        F.count(F.lit(1)).alias("n"),
    )
    return keys.groupBy("dataset_name", "dataset_version").agg(
        F.sum("n").alias("materialized_rows"),
        F.count(F.lit(1)).alias("stored_rows"),
        *[F.sum(s).alias(f"{s}_rows") for s in SPLITS],
    )


def feature_totals(features: DataFrame) -> DataFrame:
    return features.groupBy("dataset_version").agg(
        F.sum("is_fraud").alias("fraud_rows"), F.count(F.lit(1)).alias("rows")
    )


def feature_lookup(
    features: DataFrame,
    dataset_version: str | None = None,
    split: str | None = None,
    is_fraud: bool | None = None,
) -> DataFrame:
    """Filter by the partition columns (pruned) and the label (pushed down)."""
    if dataset_version is not None:
        features = features.filter(F.col("dataset_version") == dataset_version)
    if split is not None:
        features = features.filter(F.col("split") == split)
    if is_fraud is not None:
        features = features.filter(F.col("is_fraud") == int(is_fraud))
    return features
