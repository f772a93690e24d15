"""Scoring of predictions against gold labels, per domain and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsieve.functions.numeric import safe_ratio
from callsieve.functions.verdict import is_fraud, risk_score, with_verdict
from callsieve.operators.ordering import ranges, with_starts
from callsieve.schemas import RegressionFloors

METRICS = ("precision", "recall", "f1", "pr_auc", "json_validity", "n")


def align(predictions: DataFrame, gold: DataFrame, keys: Sequence[str] = ("row_idx",)) -> DataFrame:
    """Pair predictions with gold rows one to one; the job fails if it cannot.

    Replaces reading two files side by side. Rows per key are counted on each side
    in the partitioning of the join; a repeated key fails the job before it multiplies.
    """
    per_key = Window.partitionBy(*keys)
    once = lambda name: F.when(F.count(F.lit(1)).over(per_key) == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{name} repeat a key")).cast("boolean")
    )
    left = predictions.withColumn("_p", once("predictions"))
    right = gold.withColumn("_g", once("gold rows"))
    both = left.join(right, list(keys), "full_outer")
    # The check guards the key itself, which every consumer needs.
    checked = F.when(
        F.col("_p") & F.col("_g"), F.col(keys[0])
    ).otherwise(F.raise_error(F.lit("predictions and gold rows do not match one to one")))
    return both.withColumn(keys[0], checked).filter(F.col(keys[0]).isNotNull()).drop("_p", "_g")


def score_outputs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse raw model outputs into ``pred``, ``score`` and ``json_valid``.

    What cannot be parsed counts as "not fraud" with score 0. Narrow.
    """
    risk = F.col("verdict.risk")
    return with_verdict(df, raw).select(
        "*",
        is_fraud(risk).alias("pred"),
        risk_score(risk).alias("score"),
        F.col("failure").isNull().alias("json_valid"),
    )


def _score_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    valid = F.col("json_valid") if "json_valid" in scored.columns else F.lit(None).cast("boolean")
    return scored.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("gold").alias("pos"),
        F.count_if(F.col("gold") & F.col("pred")).alias("tp"),
        F.count_if(~F.col("gold") & F.col("pred")).alias("fp"),
        F.count_if(F.col("gold") & ~F.col("pred")).alias("fn"),
        F.count_if(~F.col("gold") & ~F.col("pred")).alias("tn"),
        F.count(valid).alias("judged"),
        F.count_if(valid).alias("valid"),
    )


def _running(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add running ``cum_n`` and ``cum_pos`` over falling scores.

    Totals of earlier ranges give each range of scores its start; inside a range the
    sums are local to one task.
    """
    ranged = with_starts(ranges(counts, by, F.desc("score")), by, _n0=F.sum("n"), _pos0=F.sum("pos"))
    local = (
        Window.partitionBy(*by, "_part").orderBy("_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumn("cum_n", F.col("_n0") + F.sum("n").over(local))
        .withColumn("cum_pos", F.col("_pos0") + F.sum("pos").over(local))
        .drop("_part", "_seq", "_first", "_n0", "_pos0")
    )


def binary_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts, precision, recall, F1, average precision, validity.

    ``scored`` has booleans ``gold`` and ``pred`` and a ``score``. Rows are
    first counted per score (map-side combined), so average precision - the
    step sum over distinct thresholds - needs no sort of the rows.
    """
    by = list(by)
    running = _running(_score_counts(scored, by), by)
    totals = running.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "pos", "tp", "fp", "fn", "tn", "judged", "valid")],
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_area"),
    )
    return with_rates(totals).select(
        *by, "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1",
        safe_ratio(F.col("_area"), F.col("pos")).alias("pr_auc"),
        F.when(F.col("judged") > 0, safe_ratio(F.col("valid"), F.col("n"))).alias("json_validity"),
    )


def with_rates(counts: DataFrame, prefix: str = "") -> DataFrame:
    """Precision, recall and F1 from ``tp``/``fp``/``fn`` counts; 0 if empty."""
    tp, fp, fn = (F.col(prefix + c) for c in ("tp", "fp", "fn"))
    df = counts.withColumn(prefix + "precision", safe_ratio(tp, tp + fp)).withColumn(
        prefix + "recall", safe_ratio(tp, tp + fn)
    )
    p, r = F.col(prefix + "precision"), F.col(prefix + "recall")
    return df.withColumn(prefix + "f1", safe_ratio(2 * p * r, p + r))


def regression_gate(metrics: DataFrame, floors: RegressionFloors = RegressionFloors()) -> DataFrame:
    """Add ``gate_failed``; a missing or NaN metric fails."""
    ok = F.lit(True)
    for name, floor in (
        ("f1", floors.min_f1),
        ("pr_auc", floors.min_pr_auc),
        ("json_validity", floors.min_json_validity),
    ):
        value = F.col(name)
        ok = ok & F.coalesce((value >= floor) & ~F.isnan(value), F.lit(False))
    return metrics.withColumn("gate_failed", ~ok)


def metrics_long(metrics: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """``(name, value)`` rows; names join the id columns and the metric by ``_``."""
    values = metrics.select(
        F.concat_ws("_", *id_columns).alias("_id"), *[F.col(m).cast("double") for m in METRICS]
    )
    return (
        values.unpivot("_id", list(METRICS), "metric", "value")
        .filter(F.col("value").isNotNull())
        .select(F.concat_ws("_", "_id", "metric").alias("name"), "value")
    )


def flatten_report(report: DataFrame) -> DataFrame:
    """Metric rows of nested report documents; absent blocks are skipped."""
    blocks = F.array(
        *[
            F.struct(F.lit(f"{short}_{model}").alias("_id"), F.col(f"{block}.{model}").alias("m"))
            for block, short in (("in_distribution", "id"), ("crossdomain", "crossdomain"))
            for model in ("baseline", "llm")
        ]
    )
    rows = report.select(F.explode(blocks).alias("b")).filter("b.m is not null")
    return metrics_long(rows.select(F.col("b._id").alias("block"), "b.m.*"), ["block"])
