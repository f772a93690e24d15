"""Declared schemas, enumerations and policies. Nothing is ever inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------
# Value sets and thresholds that results must agree on.
RISKS = ("low", "medium", "high")
FRAUD_RISKS = ("medium", "high")
FRAUD_TYPES = (
    "none",
    "ssn_scam",
    "refund_scam",
    "tech_support_scam",
    "reward_scam",
    "impersonation",
    "other",
)
RISK_SCORES = {"low": 0.0, "medium": 0.5, "high": 1.0}
SPLITS = ("train", "val", "test")
MAX_TEXT_CHARS = 20_000
MAX_AUDIO_BYTES = 25 * 1024 * 1024
# --------------------------------------------------------------------------

VERDICT = T.StructType(
    [
        T.StructField("risk", T.StringType()),
        T.StructField("fraud_type", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("flagged_spans", T.ArrayType(T.StringType())),
    ]
)

# Labelled transcript. (source_rank, row_idx) replaces list order.
PAIR = T.StructType(
    [
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("verdict", VERDICT),
    ]
)

EXAMPLE = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("completion", T.StringType())]
)

RAI_CASE = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("pair_id", T.StringType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("expected_is_fraud", T.BooleanType()),
        T.StructField("prediction", T.StringType()),
    ]
)

STREAM_RECORD = T.StructType(
    [
        T.StructField("stream_partition", T.StringType()),
        T.StructField("source_offset", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)

# Columns of the feature table.
FEATURES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("turn_count", T.IntegerType()),
        T.StructField("digit_ratio", T.DoubleType()),
        T.StructField("has_url", T.IntegerType()),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("generated_at", T.StringType()),
    ]
)

MODEL_METRICS = T.StructType(
    [
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("pr_auc", T.DoubleType()),
        T.StructField("json_validity", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)

_MODEL_PAIR = T.StructType(
    [T.StructField("baseline", MODEL_METRICS), T.StructField("llm", MODEL_METRICS)]
)

METRICS_REPORT = T.StructType(
    [
        T.StructField("in_distribution", _MODEL_PAIR),
        T.StructField("crossdomain", _MODEL_PAIR),
        T.StructField("gate_failed", T.BooleanType()),
    ]
)

OPERATIONAL_METRICS = T.StructType(
    [
        T.StructField("p95_latency_ms", T.DoubleType()),
        T.StructField("error_rate", T.DoubleType()),
    ]
)

_SPLIT_META = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("fraud_ratio", T.DoubleType()),
        T.StructField("sha256", T.StringType()),
    ]
)

MANIFEST_DOC = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("git_commit", T.StringType()),
        T.StructField(
            "config_snapshot",
            T.StructType(
                [
                    T.StructField("test_size", T.DoubleType()),
                    T.StructField("val_size", T.DoubleType()),
                    T.StructField("seed", T.LongType()),
                ]
            ),
        ),
        T.StructField("splits", T.MapType(T.StringType(), _SPLIT_META)),
    ]
)

# Names and defaults of the policies are part of the contract.

@dataclass(frozen=True)
class QualityPolicy:
    min_transcript_chars: int = 1
    max_transcript_chars: int = MAX_TEXT_CHARS
    max_contract_violation_ratio: float = 0.01
    deduplicate: bool = True


@dataclass(frozen=True)
class SplitPolicy:
    test_size: float = 0.15
    val_size: float = 0.10
    seed: int = 42


@dataclass(frozen=True)
class RegressionFloors:
    min_f1: float = 0.85
    min_pr_auc: float = 0.85
    min_json_validity: float = 0.94


@dataclass(frozen=True)
class ResponsibleAIPolicy:
    min_schema_validity: float = 1.0
    min_prompt_injection_recall: float = 1.0
    min_counterfactual_consistency: float = 1.0
    max_benign_false_positive_rate: float = 0.0
    max_unsupported_span_rate: float = 0.0


@dataclass(frozen=True)
class PromotionPolicy:
    min_f1: float = 0.85
    min_pr_auc: float = 0.85
    min_json_validity: float = 0.94
    max_p95_latency_ms: float = 2000.0
    max_error_rate: float = 0.02
    require_responsible_ai: bool = True


@dataclass(frozen=True)
class DriftPolicy:
    window: int = 200
    baseline_fraud_rate: float = 0.5
    psi_alert_threshold: float = 0.25
