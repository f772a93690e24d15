"""Quality gate: classify, de-duplicate, quarantine, report, stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.functions.contract import pair_contract, text_contract
from callsieve.functions.staging import evaluate_once
from callsieve.functions.text import fingerprint
from callsieve.operators.dedup import keep_first, mark_first
from callsieve.operators.ordering import ordinal
from callsieve.schemas import QualityPolicy

DUPLICATE = "duplicate_transcript"


class QualityGateError(ValueError):
    """The share of contract violations is above the allowed one."""


def classify(pairs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Add ``ordinal``, ``fingerprint``, ``transcript_chars``, ``contract_error``.

    A frame without a ``verdict`` column is held to the text rules only.
    Narrow: one pass over the text, no shuffle.
    """
    text = F.col("transcript")
    error = (
        pair_contract(text, F.col("verdict"), policy)
        if "verdict" in pairs.columns
        else text_contract(text, policy)
    )
    return evaluate_once(pairs, contract_error=error).select(
        *pairs.columns,
        ordinal(F.col("source_rank"), F.col("row_idx")).alias("ordinal"),
        fingerprint(text).alias("fingerprint"),
        F.coalesce(F.length(text), F.lit(0)).alias("transcript_chars"),
        "contract_error",
    )


def route(classified: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Add ``reason``: NULL for accepted rows, else why the row is rejected.

    Only rows that keep the contract can make a later one a duplicate.
    """
    if not policy.deduplicate:
        return classified.withColumn("reason", F.col("contract_error"))
    clean = F.col("contract_error").isNull()
    marked = mark_first(classified, "fingerprint", eligible=clean)
    return marked.withColumn(
        "reason",
        F.coalesce(F.col("contract_error"), F.when(~F.col("is_first"), F.lit(DUPLICATE))),
    ).drop("is_first")


def quarantine(pairs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Rejected rows as ``(fingerprint, reason, transcript_chars)``, no text.

    The text is dropped before the de-duplication shuffle.
    """
    slim = classify(pairs, policy).select(
        "ordinal", "fingerprint", "transcript_chars", "contract_error"
    )
    return (
        route(slim, policy)
        .filter(F.col("reason").isNotNull())
        .select("fingerprint", "reason", "transcript_chars")
    )


def accepted(pairs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Accepted rows with their text, plus ``fingerprint`` and ``ordinal``.

    Rows that break the contract are dropped before the text is shuffled.
    """
    return accept(classify(pairs, policy), policy).drop("transcript_chars")


def accept(classified: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """Rows of a classified frame that keep the contract and come first."""
    clean = classified.filter(F.col("contract_error").isNull()).drop("contract_error")
    return keep_first(clean, "fingerprint") if policy.deduplicate else clean


def quality_report(pairs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """One-row report of counts, reasons, policy and ``passed``.

    Duplicates are counted from group sizes, so no row is joined back: one
    shuffle of map-side combined ``(error, fingerprint)`` counts.
    """
    clean = F.col("contract_error").isNull()
    key = F.when(clean, F.col("fingerprint")) if policy.deduplicate else F.lit(None)
    by_text = (
        classify(pairs, policy)
        .select("contract_error", key.cast("string").alias("key"))
        .groupBy("contract_error", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kept = F.lit(1) if policy.deduplicate else F.col("n")
    by_reason = (
        by_text.select(
            F.explode(
                F.when(
                    clean,
                    F.array(
                        F.struct(F.lit(None).cast("string").alias("reason"), kept.alias("n")),
                        F.struct(F.lit(DUPLICATE).alias("reason"), (F.col("n") - kept).alias("n")),
                    ),
                ).otherwise(
                    F.array(F.struct(F.col("contract_error").alias("reason"), F.col("n")))
                )
            ).alias("part")
        )
        .select("part.reason", F.col("part.n").cast("long").alias("n"))
        .filter("n > 0")
        .groupBy("reason")
        .agg(F.sum("n").alias("n"))
    )
    # From here on there is one row per reason: a handful.
    reason, n = F.col("reason"), F.col("n")
    duplicate = F.coalesce(reason == DUPLICATE, F.lit(False))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    counts = by_reason.agg(
        total(F.lit(True)).alias("input_rows"),
        total(reason.isNull()).alias("accepted_rows"),
        total(reason.isNotNull()).alias("rejected_rows"),
        total(duplicate).alias("duplicate_rows"),
        total(reason.isNotNull() & ~duplicate).alias("contract_violations"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.when(reason.isNotNull(), F.struct(reason, n)))
            )
        ).alias("rejection_reasons"),
    )
    ratio = F.col("contract_violations") / F.greatest(F.col("input_rows"), F.lit(1))
    return counts.select(
        "input_rows",
        "accepted_rows",
        "rejected_rows",
        "duplicate_rows",
        "contract_violations",
        ratio.alias("contract_violation_ratio"),
        "rejection_reasons",
        F.struct(
            F.lit(policy.min_transcript_chars).alias("min_transcript_chars"),
            F.lit(policy.max_transcript_chars).alias("max_transcript_chars"),
            F.lit(policy.max_contract_violation_ratio).alias("max_contract_violation_ratio"),
            F.lit(policy.deduplicate).alias("deduplicate"),
        ).alias("policy"),
        (ratio <= policy.max_contract_violation_ratio).alias("passed"),
    )


def enforce_quality(report: DataFrame) -> None:
    """Raise unless the one-row report passed."""
    row = report.select(
        "passed", "contract_violation_ratio", "policy.max_contract_violation_ratio"
    ).first()
    if not row["passed"]:
        raise QualityGateError(
            "data quality gate failed: contract_violation_ratio="
            f"{row['contract_violation_ratio']:.4f} exceeds "
            f"{row['max_contract_violation_ratio']:.4f}"
        )
