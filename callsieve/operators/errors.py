"""Error analysis of scored predictions: taxonomy, counterfactuals, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.functions.numeric import safe_ratio
from callsieve.functions.text import excerpt
from callsieve.functions.verdict import is_fraud
from callsieve.operators.evaluate import with_rates
from callsieve.operators.ordering import join_null_safe

# --- fixed values ---------------------------------------------------------
FAILURES = (
    "missing_json_object",
    "malformed_json",
    "missing_required_field",
    "invalid_enum",
    "invalid_reason",
    "invalid_flagged_spans",
    "schema_validation",
)
REVIEW_CATEGORIES = (
    "false_positive",
    "false_negative",
    "invalid_json",
    "baseline_wrong_llm_correct",
)
CATEGORIES = ("true_positive", "true_negative", *REVIEW_CATEGORIES)
# --------------------------------------------------------------------------


def error_rows(scored: DataFrame, baseline: str | None = None) -> DataFrame:
    """Add ``categories``, ``fallback_pred`` and ``baseline_pred``. Narrow."""
    gold, pred = F.col("gold"), F.col("pred")
    base = F.col(baseline) if baseline else F.lit(None).cast("boolean")
    outcome = (
        F.when(gold & pred, "true_positive")
        .when(gold, "false_negative")
        .when(pred, "false_positive")
        .otherwise("true_negative")
    )
    hint = F.col("risk_hint")
    return scored.select(
        "*",
        base.alias("baseline_pred"),
        F.array_compact(
            F.array(
                outcome,
                F.when(~F.col("json_valid"), "invalid_json"),
                F.when((base != gold) & (pred == gold), "baseline_wrong_llm_correct"),
            )
        ).alias("categories"),
        F.when(hint.isNotNull(), is_fraud(hint)).otherwise(pred).alias("fallback_pred"),
    )


def error_records(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The compact per-row record that is persisted."""
    return rows.select(
        *by,
        F.col("row_idx").alias("index"),
        F.col("gold").alias("gold_is_fraud"),
        F.col("pred").alias("predicted_is_fraud"),
        "json_valid",
        F.col("failure").alias("invalid_reason"),
        F.col("verdict.risk").alias("risk"),
        F.col("verdict.fraud_type").alias("fraud_type"),
        F.col("baseline_pred").alias("baseline_predicted_is_fraud"),
        "categories",
    )


def error_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """All counters of the analysis in one aggregation, one row per group."""
    gold, pred = F.col("gold"), F.col("pred")
    base, fall = F.col("baseline_pred"), F.col("fallback_pred")
    hint, valid = F.col("risk_hint"), F.col("json_valid")

    def confusion(prefix: str, p):
        return [
            F.count_if(gold & p).alias(prefix + "tp"),
            F.count_if(~gold & p).alias(prefix + "fp"),
            F.count_if(gold & ~p).alias(prefix + "fn"),
            F.count_if(~gold & ~p).alias(prefix + "tn"),
        ]

    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gold).alias("gold_fraud"),
        F.count_if(~gold).alias("gold_non_fraud"),
        *confusion("", pred),
        *confusion("fallback_", fall),
        *confusion("baseline_", base),
        F.count_if(~valid).alias("invalid_total"),
        F.count_if(~valid & gold).alias("invalid_gold_fraud"),
        F.count_if(~valid & ~gold).alias("invalid_gold_non_fraud"),
        *[F.count_if(F.col("failure") == f).alias(f"invalid_{f}") for f in FAILURES],
        F.count_if(gold & ~pred & valid).alias("fn_valid_output"),
        F.count_if(gold & ~pred & ~valid).alias("fn_invalid_output"),
        F.count_if((base != gold) & (pred == gold)).alias("baseline_wrong_llm_correct"),
        *[F.count_if(hint == r).alias(f"hint_{r}") for r in ("low", "medium", "high")],
    )
    return with_rates(with_rates(counts), "fallback_")


def counts_map(names: dict[str, str]) -> Column:
    """Map of label to count from counter columns, zero counts left out."""
    entries = [F.lit(x) if i == 0 else F.col(x) for kv in names.items() for i, x in enumerate(kv)]
    return F.map_filter(F.create_map(*entries), lambda _, v: v > 0)


def invalid_by_reason(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(group, reason, n)`` for reasons that occur."""
    return summary.select(
        *by,
        F.explode(counts_map({f: f"invalid_{f}" for f in FAILURES})).alias("reason", "n"),
    )


def case_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(group, category, n)`` for categories that occur.

    One partial aggregate per map task; the fixed categories are turned into
    rows only after counting, so rows are never multiplied.
    """
    wide = rows.groupBy(*by).agg(
        *[F.count_if(F.array_contains("categories", c)).alias(c) for c in CATEGORIES]
    )
    return wide.select(
        *by, F.explode(counts_map({c: c for c in CATEGORIES})).alias("category", "n")
    )


def dominant_false_positive(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Commonest raw output among false positives; ties go to the first seen."""
    by = list(by)
    per_output = (
        rows.filter(~F.col("gold") & F.col("pred"))
        .groupBy(*by, "raw")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    )
    best = per_output.groupBy(*by).agg(
        F.max_by(F.struct("raw", "n"), F.struct(F.col("n"), -F.col("first"))).alias("top"),
        F.sum("n").alias("false_positives"),
    )
    return best.select(
        *by,
        F.col("top.raw").alias("output"),
        F.col("top.n").alias("count"),
        safe_ratio(F.col("top.n"), F.col("false_positives")).alias("share_of_false_positives"),
    )


def derived_rates(summary: DataFrame, dominant: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates per group, ready for a side-by-side table."""
    joined = join_null_safe(
        summary, dominant.select(*by, "share_of_false_positives"), by, "left"
    )
    c = F.col
    return joined.select(
        *by,
        c("n").cast("double").alias("examples"),
        safe_ratio(c("gold_fraud"), c("n")).alias("fraud_prevalence"),
        "precision",
        "recall",
        "f1",
        safe_ratio(c("n") - c("invalid_total"), c("n")).alias("json_validity"),
        safe_ratio(c("fp"), c("fp") + c("tn")).alias("false_positive_rate"),
        safe_ratio(c("fn"), c("fn") + c("tp")).alias("false_negative_rate"),
        safe_ratio(c("invalid_total"), c("n")).alias("invalid_output_rate"),
        safe_ratio(c("fn_invalid_output"), c("fn")).alias("fn_share_invalid_output"),
        F.coalesce(c("share_of_false_positives"), F.lit(0.0)).alias("dominant_fp_share"),
        c("fallback_f1").alias("risk_only_f1"),
    )


def side_by_side(rates: DataFrame, domain: str, domains: Sequence[str]) -> DataFrame:
    """Metric rows with one column per domain."""
    names = [c for c in rates.columns if c != domain]
    long = rates.unpivot(domain, names, "metric", "value")
    return long.groupBy("metric").pivot(domain, list(domains)).agg(F.first("value"))


def review_sample(
    rows: DataFrame, k: int = 20, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """At most ``k`` seeded rows per review category.

    The bound on the row number is pushed below the shuffle, so a map task
    sends at most ``k`` rows per category.
    """
    by = list(by)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row_idx").cast("string")), 256)
    exploded = (
        rows.select(*by, "row_idx", "gold", "pred", "json_valid", "failure",
                    F.explode("categories").alias("category"))
        .filter(F.col("category").isin(*REVIEW_CATEGORIES))
        .withColumn("_order", order)
    )
    w = Window.partitionBy(*by, "category").orderBy("_order", "row_idx")
    return (
        exploded.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= k)
        .drop("_rn", "_order")
    )


def review_excerpts(sample: DataFrame, texts: DataFrame, limit: int = 180) -> DataFrame:
    """Attach one-line excerpts of transcript and raw output to a sample."""
    return sample.join(texts.select("row_idx", "transcript", "raw"), "row_idx").select(
        *sample.columns,
        excerpt(F.col("transcript"), limit).alias("transcript_excerpt"),
        excerpt(F.col("raw"), limit).alias("output_excerpt"),
    )
