"""Small numeric expressions shared by metrics, drift and release checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSI_EPSILON = 1e-6


def safe_ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """``numerator / denominator``, or ``empty`` where there is no denominator."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(float(empty)))


def clip_rate(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(PSI_EPSILON)), F.lit(1 - PSI_EPSILON))


def _psi_term(observed: Column, expected: Column) -> Column:
    return (observed - expected) * F.log(observed / expected)


def two_bucket_psi(rate: Column, baseline: float) -> Column:
    """Population stability index of a rate against a baseline rate."""
    observed, expected = clip_rate(rate), clip_rate(F.lit(float(baseline)))
    return _psi_term(observed, expected) + _psi_term(1 - observed, 1 - expected)
