"""Writers. Every one overwrites its own target, so a rerun is harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.functions.verdict import render_completion, render_prompt
from callsieve.schemas import FEATURES, SPLITS
from callsieve.sources.feature_table import upsert


def to_examples(pairs: DataFrame) -> DataFrame:
    """Add ``prompt`` and ``completion`` rendered from a pair."""
    return pairs.withColumn("prompt", render_prompt(F.col("transcript"))).withColumn(
        "completion", render_completion(F.col("verdict"))
    )


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON per split, with the row position the readers order by."""
    examples.select("split", "row_idx", "prompt", "completion").write.mode(
        "overwrite"
    ).partitionBy("split").json(path)


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Metadata of rejected rows only; text never reaches this table."""
    rejected.select("fingerprint", "reason", "transcript_chars").write.mode("overwrite").json(path)


def write_report(one_row: DataFrame, path: str) -> None:
    """A report of a few rows as a single JSON file."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def to_prediction_records(raw: DataFrame) -> DataFrame:
    """JSON records; the row position goes along, so files need no order."""
    record = F.struct("row_idx", F.coalesce("raw", F.lit("")).alias("prediction"))
    return raw.select(F.to_json(record).alias("value"))


def write_predictions(raw: DataFrame, path: str) -> None:
    to_prediction_records(raw).write.mode("overwrite").text(path)


def checked_features(features: DataFrame) -> DataFrame:
    """Feature rows as they are; one that breaks a column's constraint fails the job."""
    c = F.col
    rules = {
        "split": c("split").isin(*SPLITS),
        "char_count": c("char_count") >= 0,
        "word_count": c("word_count") >= 0,
        "turn_count": c("turn_count") >= 1,
        "digit_ratio": c("digit_ratio").between(0, 1),
        "has_url": c("has_url").isin(0, 1),
        "is_fraud": c("is_fraud").isin(0, 1),
        "dataset_name": c("dataset_name").isNotNull(),
        "dataset_version": c("dataset_version").isNotNull(),
        "entity_id": c("entity_id").isNotNull(),
    }
    checked = {
        name: F.when(F.coalesce(rule, F.lit(False)), c(name)).otherwise(
            F.raise_error(F.lit(f"feature table: {name} breaks its constraint")).cast(features.schema[name].dataType)
        )
        for name, rule in rules.items()
    }
    return features.withColumns(checked)


def write_features(features: DataFrame, path: str) -> None:
    """Upsert by ``(entity_id, dataset_version)`` into the stored table.

    ``features`` may be a part of a version: rows of other keys stay, a key that is
    stored in another split moves. Only buckets of the keys at hand are read and written; they
    count from one rename on, so a failure before that leaves the stored table as it was.
    """
    upsert(checked_features(features.select(*[f.name for f in FEATURES.fields])), path)


def write_error_rows(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_metrics(long_metrics: DataFrame, path: str) -> None:
    long_metrics.write.mode("overwrite").parquet(path)
