import pytest
from pyspark.sql import functions as F

from callsieve.functions.verdict import make_verdict
from callsieve.operators import quality as Q
from callsieve.schemas import PAIR, QualityPolicy

LOW, HIGH = ("low", "none", "r", []), ("high", "other", "r", ["pay"])


def pairs(spark, *rows):
    return spark.createDataFrame([(0, i, t, v) for i, (t, v) in enumerate(rows)], PAIR)


def sample(spark):
    return pairs(
        spark,
        ("please pay now", HIGH),
        ("please  pay\nnow", HIGH),            # same text, re-spaced
        ("", LOW),
        ("hello", ("low", "other", "r", [])),
        ("hello", LOW),                        # its earlier copy was rejected: accepted
        ("hello", LOW),
        (None, LOW),
        ("other", ("high", "other", "r", ["absent"])),
    )


def test_quarantine_keeps_no_text_and_orders_rules(spark):
    rows = Q.quarantine(sample(spark)).collect()
    assert set(rows[0].asDict()) == {"fingerprint", "reason", "transcript_chars"}
    assert sorted(r.reason for r in rows) == [
        "duplicate_transcript", "duplicate_transcript", "flagged_span_not_verbatim",
        "inconsistent_low_risk_fraud_type", "transcript_not_string", "transcript_too_short",
    ]
    assert all(len(r.fingerprint) == 64 for r in rows)


def test_first_accepted_wins(spark):
    assert sorted(r.row_idx for r in Q.accepted(sample(spark)).collect()) == [0, 4]


def test_report_counts_duplicates_apart(spark):
    r = Q.quality_report(sample(spark)).first()
    assert (r.input_rows, r.accepted_rows, r.rejected_rows) == (8, 2, 6)
    assert (r.duplicate_rows, r.contract_violations) == (2, 4)
    assert r.contract_violation_ratio == 0.5 and r.passed is False
    keys = Q.quality_report(sample(spark)).select(F.map_keys("rejection_reasons").alias("k")).first().k
    assert keys == sorted(keys) and len(keys) == 5
    assert r.rejection_reasons["duplicate_transcript"] == 2
    assert r.policy.max_contract_violation_ratio == 0.01


def test_gate_raises_only_above_the_limit(spark):
    with pytest.raises(ValueError, match="data quality gate failed"):
        Q.enforce_quality(Q.quality_report(sample(spark)))
    Q.enforce_quality(Q.quality_report(sample(spark), QualityPolicy(max_contract_violation_ratio=0.5)))


def test_without_deduplication(spark):
    policy = QualityPolicy(deduplicate=False)
    r = Q.quality_report(sample(spark), policy).first()
    assert (r.accepted_rows, r.duplicate_rows) == (4, 0)
    assert Q.accepted(sample(spark), policy).count() == 4


def test_empty_input(spark):
    r = Q.quality_report(spark.createDataFrame([], PAIR)).first()
    assert (r.input_rows, r.accepted_rows, r.passed, r.rejection_reasons) == (0, 0, True, {})


def test_one_text_holding_a_third_of_all_rows(spark):
    """Hot fingerprint: the result is that of the row-by-row rule."""
    df = spark.range(3000).select(
        F.lit(0).alias("source_rank"), F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.col("id").cast("string")).alias("transcript"),
        make_verdict("low", "none", "r").alias("verdict"),
    )
    kept = Q.accepted(df)
    assert kept.count() == 2001
    assert kept.filter(F.col("transcript") == "the hot text").first().row_idx == 0
    assert Q.quality_report(df).first().duplicate_rows == 999


def test_not_in_leaves_new_keys(spark):
    from callsieve.operators.dedup import not_in

    seen = spark.createDataFrame([("a",), ("a",), (None,)], "fingerprint string")
    new = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "fingerprint string, n int")
    assert sorted(r.n for r in not_in(new, seen, ["fingerprint"]).collect()) == [2, 3]
