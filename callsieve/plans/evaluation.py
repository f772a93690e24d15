"""Evaluation of saved predictions up to the promotion decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.operators import errors, evaluate, release
from callsieve.operators.control import score_control, train_control
from callsieve.schemas import PromotionPolicy, RegressionFloors, ResponsibleAIPolicy
from callsieve.sources.files import load_predictions, load_split


def score_domain(
    spark: SparkSession, split_path: str, predictions_path: str, domain: str, json_records: bool | None = None
) -> DataFrame:
    """Aligned and scored model outputs of one domain."""
    gold = load_split(spark, split_path).select("row_idx", "transcript", "gold")
    raw = load_predictions(spark, predictions_path, json_records)
    return evaluate.score_outputs(evaluate.align(raw, gold)).withColumn("domain", F.lit(domain))


def evaluate_models(
    llm_scored: DataFrame,
    baseline_scored: DataFrame | None = None,
    gated_domain: str = "id",
    floors: RegressionFloors = RegressionFloors(),
) -> DataFrame:
    """Metrics per (domain, model). Only the model in the gated domain gates."""
    metrics = evaluate.binary_metrics(llm_scored, ["domain"]).withColumn("model", F.lit("llm"))
    if baseline_scored is not None:
        metrics = metrics.unionByName(
            evaluate.binary_metrics(baseline_scored, ["domain"]).withColumn(
                "model", F.lit("baseline")
            )
        )
    gated = evaluate.regression_gate(metrics, floors)
    applies = (F.col("domain") == gated_domain) & (F.col("model") == "llm")
    return gated.withColumn("gate_failed", F.col("gate_failed") & applies)


def fit_and_score_control(
    spark: SparkSession, train_path: str, test_paths: dict[str, str], **settings
) -> DataFrame:
    """Fit once on the training split, score every domain with the same model."""
    model = train_control(load_split(spark, train_path), **settings)
    frames = [
        score_control(model, load_split(spark, path).select("row_idx", "transcript", "gold"))
        .drop("transcript")
        .withColumn("domain", F.lit(domain))
        for domain, path in test_paths.items()
    ]
    scored = frames[0]
    for frame in frames[1:]:
        scored = scored.unionByName(frame)
    return scored


def analyse(llm_scored: DataFrame, baseline_scored: DataFrame | None = None) -> DataFrame:
    """Per-row analysis, with the control's predictions on the same rows."""
    if baseline_scored is None:
        return errors.error_rows(llm_scored)
    base = baseline_scored.select("domain", "row_idx", F.col("pred").alias("_base"))
    paired = evaluate.align(llm_scored, base, ["row_idx", "domain"])
    return errors.error_rows(paired, "_base").drop("_base")


def decide(
    candidates: DataFrame,
    metrics: DataFrame,
    operational: DataFrame,
    rai_cases: DataFrame,
    rai_policy: ResponsibleAIPolicy = ResponsibleAIPolicy(),
    policy: PromotionPolicy = PromotionPolicy(),
    key: str = "candidate",
) -> DataFrame:
    """Promotion decision per candidate from all three kinds of evidence."""
    rai = release.rai_checks(release.rai_metrics(rai_cases, [key]), rai_policy)
    evidence = release.promotion_evidence(candidates, metrics, operational, rai, key)
    return release.promotion_decision(evidence, policy)
