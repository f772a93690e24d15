"""Row contracts: one ordered CASE per contract, first broken rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.functions.staging import evaluate_once
from callsieve.functions.text import is_blank, strip
from callsieve.functions.verdict import json_kind, sole_json_value, unsupported_span
from callsieve.schemas import (
    FRAUD_RISKS,
    FRAUD_TYPES,
    MAX_AUDIO_BYTES,
    MAX_TEXT_CHARS,
    RISKS,
    QualityPolicy,
)

# --- fixed values ---------------------------------------------------------
# Call-event fields in contract order with their length limits, and the
# magnitude above which a numeric timestamp is read as milliseconds.
EVENT_TEXT_LIMITS = {"event_id": 128, "source": 64, "transcript": MAX_TEXT_CHARS}
EVENT_FIELDS = ("event_id", "occurred_at", "source", "transcript")
MILLIS_WATERSHED = 2e10
# --------------------------------------------------------------------------

_MAX_EPOCH_SECONDS = 253402300799  # end of year 9999
_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[Tt _](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    r"(Z|z|([+\-\x{2212}])([01]\d|2[0-3]):?([0-5]\d))?)?$"
)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def text_contract(transcript: Column, policy: QualityPolicy = QualityPolicy()) -> Column:
    """Reason a transcript breaks the text rules, or NULL."""
    size = F.length(strip(transcript))
    return (
        F.when(transcript.isNull(), "transcript_not_string")
        .when(size < policy.min_transcript_chars, "transcript_too_short")
        .when(size > policy.max_transcript_chars, "transcript_too_long")
    )


def pair_contract(
    transcript: Column, verdict: Column, policy: QualityPolicy = QualityPolicy()
) -> Column:
    """Reason a (transcript, verdict) pair breaks the contract, or NULL."""
    risk, kind = verdict["risk"], verdict["fraud_type"]
    spans = verdict["flagged_spans"]
    valid = (
        F.coalesce(risk.isin(*RISKS), F.lit(False))
        & F.coalesce(kind.isin(*FRAUD_TYPES), F.lit(False))
        & F.coalesce(F.length(verdict["reason"]) >= 1, F.lit(False))
        & ~F.coalesce(F.exists(spans, lambda s: s.isNull()), F.lit(False))
    )
    verdict_rules = (
        F.when(verdict.isNull(), "verdict_not_object")
        .when(~valid, "invalid_verdict_schema")
        .when((risk == "low") & (kind != "none"), "inconsistent_low_risk_fraud_type")
        .when(risk.isin(*FRAUD_RISKS) & (kind == "none"), "inconsistent_fraud_risk_type")
        .when(unsupported_span(spans, transcript), "flagged_span_not_verbatim")
    )
    return F.coalesce(text_contract(transcript, policy), verdict_rules)


def zoned_timestamp(text: Column) -> Column:
    """Struct ``(instant, zoned)`` of an ISO or epoch text.

    ``instant`` is NULL if the text is no date at all; ``zoned`` tells whether
    it named a zone. Offsets are applied by interval arithmetic because the
    engine's own parser stops at 18 hours.
    """

    def part(i: int) -> Column:
        return F.regexp_extract(text, _ISO, i)

    def or_zero(c: Column) -> Column:
        return F.when(c == "", F.lit("00")).otherwise(c)

    clock = F.when(part(2) == "", F.lit("00:00")).otherwise(part(2))
    wall = F.concat(
        part(1), F.lit(" "), clock, F.lit(":"), or_zero(part(3)), F.lit("."),
        F.rpad(F.substring(part(4), 1, 6), 6, "0"), F.lit("Z"),
    )
    sign = F.when(part(6) == "+", F.lit(-1)).when(part(6) == "", F.lit(0)).otherwise(F.lit(1))
    shift = F.make_dt_interval(
        F.lit(0),
        sign * F.coalesce(part(7).try_cast("int"), F.lit(0)),
        sign * F.coalesce(part(8).try_cast("int"), F.lit(0)),
    )
    dated = (part(1) != "") & ~part(1).startswith("0000")
    iso = F.when(dated, wall.try_cast("timestamp") + shift)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.struct(
        F.coalesce(iso, epoch_timestamp(number)).alias("instant"),
        ((part(5) != "") | number.isNotNull()).alias("zoned"),
    )


def epoch_timestamp(number: Column) -> Column:
    """Epoch seconds, or milliseconds beyond the watershed, as an instant."""
    seconds = F.when(F.abs(number) > MILLIS_WATERSHED, number / 1000).otherwise(number)
    return F.when(
        F.abs(seconds) <= _MAX_EPOCH_SECONDS, F.timestamp_micros((seconds * 1000000).cast("long"))
    )


_NUMERIC_KINDS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def with_event(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``event`` (struct or NULL) and ``error_code`` (NULL if valid)."""
    value = F.col("_value")
    staged = df.withColumn("_value", sole_json_value(F.col(payload))).withColumn(
        "_fields",
        F.struct(
            F.schema_of_variant(value).alias("kind"),
            *[json_kind(value, name).alias(f"{name}_kind") for name in EVENT_FIELDS],
            *[
                F.try_variant_get(value, f"$.{name}", "string").alias(name)
                for name in EVENT_FIELDS
            ],
            F.try_variant_get(value, "$.occurred_at", "double").alias("epoch"),
        ),
    )
    f = F.col("_fields")
    numeric = f["occurred_at_kind"].rlike(_NUMERIC_KINDS)
    staged = staged.withColumn(
        "_time",
        F.when(
            numeric,
            F.struct(epoch_timestamp(f["epoch"]).alias("instant"), F.lit(True).alias("zoned")),
        ).otherwise(zoned_timestamp(f["occurred_at"])),
    )
    when = F.col("_time")

    def text_rule(name: str) -> Column:
        kind, size = f[f"{name}_kind"], F.length(f[name])
        return (
            F.when(kind.isNull(), f"invalid_event:{name}:missing")
            .when(kind != "STRING", f"invalid_event:{name}:string_type")
            .when(size < 1, f"invalid_event:{name}:string_too_short")
            .when(size > EVENT_TEXT_LIMITS[name], f"invalid_event:{name}:string_too_long")
            .when(is_blank(f[name]), f"invalid_event:{name}:value_error")
        )

    at = "invalid_event:occurred_at:"
    time_kind = f["occurred_at_kind"]
    time_rule = (
        F.when(time_kind.isNull(), at + "missing")
        .when(numeric & when["instant"].isNull(), at + "datetime_parsing")
        .when(~numeric & (time_kind != "STRING"), at + "datetime_type")
        .when(f["occurred_at"].startswith("0000-") & when["instant"].isNull(),
              at + "datetime_parsing")
        .when(when["instant"].isNull(), at + "datetime_from_date_parsing")
        .when(~when["zoned"], at + "value_error")
    )
    error = (
        F.when(F.col("_value").isNull(), "invalid_json")
        .when(~f["kind"].startswith("OBJECT"), "invalid_event::model_type")
        .otherwise(
            F.coalesce(
                text_rule("event_id"), time_rule, text_rule("source"), text_rule("transcript")
            )
        )
    )
    staged = evaluate_once(staged, error_code=error, _instant=when["instant"])
    event = F.struct(
        f["event_id"].alias("event_id"),
        F.col("_instant").alias("occurred_at"),
        f["occurred_at"].alias("occurred_at_raw"),
        f["source"].alias("source"),
        f["transcript"].alias("transcript"),
    )
    return staged.withColumn("event", F.when(F.col("error_code").isNull(), event)).drop(
        "_value", "_fields", "_time", "_instant"
    )


def text_intake(transcript: Column, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Reason an incoming text is refused, or NULL."""
    return F.when(F.length(transcript) > max_chars, "transcript_too_large")


def audio_intake(size_bytes: Column, max_bytes: int = MAX_AUDIO_BYTES) -> Column:
    """Reason an incoming recording is refused by its byte length, or NULL."""
    return F.when(size_bytes == 0, "audio_empty").when(size_bytes > max_bytes, "audio_too_large")
