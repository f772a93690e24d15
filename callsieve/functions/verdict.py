"""Verdict expressions: rendering, label mapping and strict JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.functions.staging import evaluate_once
from callsieve.functions.text import strip
from callsieve.schemas import FRAUD_RISKS, FRAUD_TYPES, RISK_SCORES, RISKS

# --- fixed values ---------------------------------------------------------
# Prompt text, label taxonomy, reason templates and the fallback verdict.
SYSTEM_PROMPT = (
    "You are a fraud-triage analyst. Read the phone-call transcript and respond "
    "with ONLY a JSON object: {risk, fraud_type, reason, flagged_spans}. "
    "flagged_spans must be verbatim phrases from the transcript."
)
CALL_TYPE_MAP = {
    "ssn": "ssn_scam",
    "refund": "refund_scam",
    "support": "tech_support_scam",
    "tech_support": "tech_support_scam",
    "tech": "tech_support_scam",
    "reward": "reward_scam",
    "prize": "reward_scam",
    "lottery": "reward_scam",
    "gift": "reward_scam",
    "impersonation": "impersonation",
    "irs": "impersonation",
    "bank": "impersonation",
    "government": "impersonation",
}
SCAM_REASON = "Caller exhibits a scam pattern."
SCAM_REASON_TYPED = "Caller exhibits a %s scam pattern."
LEGIT_REASON = "No fraud indicators; appears to be a legitimate call."
LEGIT_REASON_TYPED = "No fraud indicators; appears to be a legitimate %s call."
EMAIL_FRAUD_REASON = "Cross-domain email labeled fraudulent (advance-fee / scam pattern)."
EMAIL_LEGIT_REASON = "Cross-domain email labeled non-fraudulent."
DOMAIN_FRAUD_REASON = "Cross-domain %s text labeled deceptive."
DOMAIN_LEGIT_REASON = "Cross-domain %s text labeled non-deceptive."
FALLBACK_REASON = "Model output could not be parsed; flagged for manual review."
JSON_PRIMER = ' {"risk": "'
# --------------------------------------------------------------------------


def make_verdict(risk, fraud_type, reason, spans=None) -> Column:
    """Verdict struct from columns or plain strings."""

    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    spans = F.array().cast("array<string>") if spans is None else spans
    return F.struct(
        col(risk).alias("risk"),
        col(fraud_type).alias("fraud_type"),
        col(reason).alias("reason"),
        spans.alias("flagged_spans"),
    )


def is_fraud(risk: Column) -> Column:
    """Binary projection of a risk; a missing risk counts as not fraud."""
    return F.coalesce(risk.isin(*FRAUD_RISKS), F.lit(False))


def risk_score(risk: Column) -> Column:
    chain = F.lit(0.0)
    for name, score in RISK_SCORES.items():
        chain = F.when(risk == name, F.lit(score)).otherwise(chain)
    return chain


def clean_call_type(call_type: Column) -> Column:
    return F.lower(strip(F.coalesce(call_type, F.lit(""))))


def fraud_type_of_call(call_type: Column) -> Column:
    """Exact taxonomy entry, else the first entry contained, else ``other``."""
    kind = clean_call_type(call_type)
    exact = F.create_map(*[F.lit(x) for pair in CALL_TYPE_MAP.items() for x in pair])
    found = F.try_element_at(exact, kind)
    partial = F.lit(None).cast("string")
    for key, value in reversed(CALL_TYPE_MAP.items()):
        partial = F.when(F.contains(kind, F.lit(key)), F.lit(value)).otherwise(partial)
    return F.coalesce(found, partial, F.lit("other"))


def call_verdict(is_scam: Column, call_type: Column) -> Column:
    kind = clean_call_type(call_type)
    scam = make_verdict(
        "high",
        fraud_type_of_call(call_type),
        F.when(kind == "", SCAM_REASON).otherwise(F.format_string(SCAM_REASON_TYPED, kind)),
    )
    legit = make_verdict(
        "low",
        "none",
        F.when(kind == "", LEGIT_REASON).otherwise(F.format_string(LEGIT_REASON_TYPED, kind)),
    )
    return F.when(F.coalesce(is_scam, F.lit(False)), scam).otherwise(legit)


def email_verdict(label: Column) -> Column:
    fraud = F.coalesce(F.upper(strip(label.cast("string"))) == "FRAUD", F.lit(False))
    return F.when(fraud, make_verdict("high", "other", EMAIL_FRAUD_REASON)).otherwise(
        make_verdict("low", "none", EMAIL_LEGIT_REASON)
    )


def domain_verdict(label: Column, domain: Column) -> Column:
    pretty = F.translate(domain, "_", " ")
    deceptive = F.coalesce(label.cast("int") == 1, F.lit(False))
    return F.when(
        deceptive, make_verdict("high", "other", F.format_string(DOMAIN_FRAUD_REASON, pretty))
    ).otherwise(make_verdict("low", "none", F.format_string(DOMAIN_LEGIT_REASON, pretty)))


def render_prompt(transcript: Column) -> Column:
    return F.concat(
        F.lit(SYSTEM_PROMPT + "\n\nTranscript:\n"), transcript, F.lit("\n\nVerdict:")
    )


def _json_text(value: Column) -> Column:
    """One JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def render_completion(verdict: Column) -> Column:
    """Verdict as JSON text with ``", "`` and ``": "`` separators."""
    spans = F.array_join(F.transform(verdict["flagged_spans"], _json_text), ", ")
    return F.concat(
        F.lit('{"risk": '), _json_text(verdict["risk"]),
        F.lit(', "fraud_type": '), _json_text(verdict["fraud_type"]),
        F.lit(', "reason": '), _json_text(verdict["reason"]),
        F.lit(', "flagged_spans": ['), F.coalesce(spans, F.lit("")), F.lit("]}"),
    )


def training_text(prompt: Column, completion: Column, eos: str = "") -> Column:
    return F.concat(prompt, F.lit(" "), completion, F.lit(eos))


def add_primer(prompt: Column) -> Column:
    return F.concat(prompt, F.lit(JSON_PRIMER))


def restore_primer(continuation: Column) -> Column:
    return F.concat(F.lit(JSON_PRIMER.lstrip()), continuation)


def json_object_slice(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; NULL where there is none."""
    start = F.instr(raw, "{")
    end = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    closed = F.contains(raw, F.lit("}"))
    return F.when((start > 0) & closed & (end > start), F.substring(raw, start, end - start + 1))


def sole_json_value(text: Column) -> Column:
    """The one JSON value in ``text`` as VARIANT; NULL if malformed or several.

    Wrapping in brackets makes trailing content an error, which the parser
    would otherwise ignore after the first value.
    """
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    return F.when(F.size(items) == 1, items[0])


def json_kind(value: Column, key: str) -> Column:
    """Type name of a member; SQL NULL if the member is absent."""
    return F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))


def with_verdict(df: DataFrame, raw: str = "raw", prefix: str = "") -> DataFrame:
    """Add ``verdict`` (struct or NULL), ``failure`` and ``risk_hint`` columns.

    The JSON text is parsed once per row however many columns are derived from
    it, and filters on the results do not repeat the work. Narrow: no shuffle.
    """
    names = {n: prefix + n for n in ("verdict", "failure", "risk_hint")}
    parsed = (
        df.withColumn("_fragment", json_object_slice(F.col(raw)))
        .withColumn("_object", sole_json_value(F.col("_fragment")))
        .withColumn(
            "_fields",
            F.struct(
                json_kind(F.col("_object"), "risk").alias("risk_kind"),
                json_kind(F.col("_object"), "fraud_type").alias("type_kind"),
                json_kind(F.col("_object"), "reason").alias("reason_kind"),
                json_kind(F.col("_object"), "flagged_spans").alias("spans_kind"),
                F.try_variant_get("_object", "$.risk", "string").alias("risk"),
                F.try_variant_get("_object", "$.fraud_type", "string").alias("fraud_type"),
                F.try_variant_get("_object", "$.reason", "string").alias("reason"),
                F.try_variant_get("_object", "$.flagged_spans", "array<string>").alias("spans"),
            ),
        )
    )
    f = F.col("_fields")
    text = "STRING"
    required = F.greatest(
        f["risk_kind"].isNull(), f["type_kind"].isNull(), f["reason_kind"].isNull()
    )
    risk_ok = (f["risk_kind"] == text) & f["risk"].isin(*RISKS)
    type_ok = (f["type_kind"] == text) & f["fraud_type"].isin(*FRAUD_TYPES)
    reason_ok = (f["reason_kind"] == text) & (F.length(f["reason"]) >= 1)
    spans_ok = f["spans_kind"].isNull() | (
        f["spans_kind"].isin("ARRAY<STRING>", "ARRAY<VOID>")
        & ~F.exists(f["spans"], lambda s: s.isNull())
    )
    failure = (
        F.when(F.col("_fragment").isNull(), "missing_json_object")
        .when(F.col("_object").isNull(), "malformed_json")
        .when(required, "missing_required_field")
        .when(~F.coalesce(risk_ok & type_ok, F.lit(False)), "invalid_enum")
        .when(~F.coalesce(reason_ok, F.lit(False)), "invalid_reason")
        .when(~F.coalesce(spans_ok, F.lit(False)), "invalid_flagged_spans")
    )
    spans = F.coalesce(f["spans"], F.array().cast("array<string>"))
    staged = evaluate_once(
        parsed,
        **{
            names["failure"]: failure,
            "_spans": spans,
            names["risk_hint"]: F.when(failure.isNotNull() & risk_ok, f["risk"]),
        },
    )
    verdict = make_verdict(f["risk"], f["fraud_type"], f["reason"], F.col("_spans"))
    return staged.withColumn(
        names["verdict"], F.when(F.col(names["failure"]).isNull(), verdict)
    ).drop("_fragment", "_object", "_fields", "_spans")


def unsupported_span(spans: Column, transcript: Column) -> Column:
    """True if any span does not occur verbatim in the transcript."""
    return F.exists(spans, lambda s: ~F.contains(transcript, s))


def fallback_verdict() -> Column:
    return make_verdict("medium", "other", FALLBACK_REASON)


