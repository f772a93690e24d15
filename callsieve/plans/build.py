"""Batch build of a dataset: gate, split, examples, manifest, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.operators import features as feat
from callsieve.operators import quality as q
from callsieve.operators import split as sp
from callsieve.schemas import QualityPolicy, SplitPolicy
from callsieve.sources import sinks
from callsieve.sources.files import gold_of_examples


def build_dataset(
    spark: SparkSession,
    pairs: DataFrame,
    out: str,
    dataset: str,
    quality: QualityPolicy = QualityPolicy(),
    policy: SplitPolicy = SplitPolicy(),
    eval_only: bool = False,
    generated_at: str | None = None,
    git_commit: str | None = None,
) -> DataFrame:
    """Build everything under ``out``; returns the manifest.

    Diagnostics are written before the gate may stop the run. Accepted rows
    are written once and read back, so later steps neither repeat the gate nor
    depend on executors that may be lost.
    """
    sinks.write_quarantine(q.quarantine(pairs, quality), f"{out}/quarantine")
    sinks.write_report(q.quality_report(pairs, quality), f"{out}/quality_report")
    report = spark.read.schema(
        "contract_violation_ratio double, passed boolean, accepted_rows long, "
        "policy struct<max_contract_violation_ratio: double>"
    ).json(f"{out}/quality_report")
    q.enforce_quality(report)
    if report.first()["accepted_rows"] == 0:
        raise RuntimeError(f"dataset '{dataset}' produced no rows")

    sp.with_label(q.accepted(pairs, quality)).write.mode("overwrite").parquet(f"{out}/accepted")
    kept = spark.read.parquet(f"{out}/accepted").withColumnRenamed("row_idx", "source_row")
    labelled = sp.assign_splits(kept, "ordinal", policy, eval_only)
    examples = sinks.to_examples(labelled.withColumn("row_idx", F.col("ordinal")))
    sinks.write_examples(examples, f"{out}/examples")

    written = spark.read.schema(
        "row_idx long, prompt string, completion string, split string"
    ).json(f"{out}/examples")
    manifest = sp.split_manifest(
        gold_of_examples(written.withColumn("_prompt", F.col("prompt")))
        .withColumnRenamed("_prompt", "prompt")
        .withColumnRenamed("gold", "is_fraud"),
        dataset,
        policy,
        generated_at=generated_at,
        git_commit=git_commit,
    )
    sinks.write_report(manifest, f"{out}/manifest")
    return spark.read.schema(manifest.schema).json(f"{out}/manifest")


def materialize_features(
    spark: SparkSession, build_dir: str, store: str, generated_at: str | None = None
) -> DataFrame:
    """Feature table of a build, idempotent per version; returns the report."""
    manifest = spark.read.schema("dataset string, split string, checksum string").json(
        f"{build_dir}/manifest"
    )
    version = sp.dataset_version(manifest).first()
    examples = spark.read.schema(
        "row_idx long, prompt string, completion string, split string"
    ).json(f"{build_dir}/examples")
    rows = feat.extract_features(
        gold_of_examples(examples).withColumnRenamed("gold", "is_fraud"),
        version["dataset_version"],
        version["dataset"],
        generated_at,
    )
    sinks.write_features(feat.latest_features(rows), store)
    return feat.materialize_report(rows)
