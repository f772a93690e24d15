"""The registered queries in plain SQL, for checking results elsewhere.

Written for DuckDB over views named like the shared test tables, and on
purpose by the most direct formulation - window functions over whole groups,
brute-force expansion - rather than by that of the Spark operators.
"""

from __future__ import annotations

from callsieve.functions.text import LINE_BREAKS, WHITESPACE, digit_class
from callsieve.functions.verdict import (
    CALL_TYPE_MAP,
    DOMAIN_FRAUD_REASON,
    DOMAIN_LEGIT_REASON,
    EMAIL_FRAUD_REASON,
    EMAIL_LEGIT_REASON,
    FALLBACK_REASON,
    SYSTEM_PROMPT,
)
from callsieve.operators.control import TOKEN_PATTERN
from callsieve.operators.errors import FAILURES
from callsieve.operators.telemetry import LATENCY_BOUNDS, PERCENTILES, percentile_name
from callsieve.plans.inputs import CALL_TYPES, EPOCH_2026, SPAM_TYPES

WS, LB = f"[{WHITESPACE}]", f"[{LINE_BREAKS}]"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def _fp(t: str) -> str:
    return f"sha256({_norm(t)})"


def _features(t: str) -> str:
    return f"""
      length({t})::INTEGER AS char_count,
      len(regexp_extract_all({t}, '[^{WHITESPACE}]+'))::INTEGER AS word_count,
      greatest(len(list_filter(regexp_split_to_array({t}, '\\r\\n|{LB}'),
               lambda x: regexp_matches(x, '[^{WHITESPACE}]'))), 1)::INTEGER AS turn_count,
      round(len(regexp_extract_all({t}, '[{digit_class()}]'))::DOUBLE
            / greatest(length({t}), 1), 12) AS digit_ratio,
      (contains(lower({t}), 'http://') OR contains(lower({t}), 'https://')
       OR contains(lower({t}), 'www.'))::INTEGER AS has_url"""


# --- derived frames ------------------------------------------------------------

PAIRS = f"""
pairs AS (
  SELECT d.doc_id AS row_idx, d.text AS transcript, d.lang, d.doc_id % 47 <> 0 AS has_verdict,
    CASE WHEN d.doc_id % 43 = 0 THEN 'extreme'
         WHEN coalesce(l.toxic, 0) = 1 AND d.doc_id % 37 <> 0 THEN 'high' ELSE 'low' END AS risk,
    CASE WHEN d.doc_id % 37 = 0 THEN 'other'
         WHEN coalesce(l.toxic, 0) = 1 THEN ({_list(SPAM_TYPES)})[(d.doc_id % 6)::INTEGER + 1]
         ELSE 'none' END AS fraud_type,
    CASE WHEN d.doc_id % 41 = 0 THEN '<not in the transcript>'
         WHEN coalesce(l.toxic, 0) = 1 THEN regexp_extract(d.text, '^\\S+') END AS span
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
routed0 AS (
  SELECT *, {_fp('transcript')} AS fingerprint, length(transcript) AS transcript_chars,
    CASE WHEN length({_strip('transcript')}) < 1 THEN 'transcript_too_short'
         WHEN length({_strip('transcript')}) > 20000 THEN 'transcript_too_long'
         WHEN NOT has_verdict THEN 'verdict_not_object'
         WHEN risk = 'extreme' THEN 'invalid_verdict_schema'
         WHEN risk = 'low' AND fraud_type <> 'none' THEN 'inconsistent_low_risk_fraud_type'
         WHEN risk <> 'low' AND fraud_type = 'none' THEN 'inconsistent_fraud_risk_type'
         WHEN span IS NOT NULL AND NOT contains(transcript, span) THEN 'flagged_span_not_verbatim'
    END AS error
  FROM pairs),
routed AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN error
    WHEN row_number() OVER (PARTITION BY fingerprint, error IS NULL ORDER BY row_idx) > 1
    THEN 'duplicate_transcript' END AS reason
  FROM routed0)"""


def _raw(i: str, fraud: str) -> str:
    said = f"(CASE WHEN {i} % 7 = 0 THEN NOT ({fraud}) ELSE ({fraud}) END)"
    risk = f"""(CASE WHEN {i} % 7 = 0 THEN CASE WHEN {said} THEN 'high' ELSE 'low' END
        WHEN {i} % 17 = 0 THEN 'extreme' WHEN {said} AND {i} % 5 = 0 THEN 'medium'
        WHEN {said} THEN 'high' ELSE 'low' END)"""
    head = (
        f"""'{{"risk": "' || {risk} || '", "fraud_type": "' || """
        f"""CASE WHEN {said} THEN 'other' ELSE 'none' END || '"'"""
    )
    tail = (
        f"""', "flagged_spans": ' || CASE WHEN {i} % 23 = 0 """
        f"""THEN '["evidence not present"]' ELSE '[]' END || '}}'"""
    )
    good = f"""({head} || ', "reason": "Caller exhibits a scam pattern."' || {tail})"""
    prose = f"(CASE WHEN {i} % 2 = 0 THEN 'Answer: ' || {good} || ' end' ELSE {good} END)"
    return f"""(CASE WHEN {i} % 7 = 0 THEN {prose} WHEN {i} % 11 = 0 THEN 'not json'
      WHEN {i} % 13 = 0 THEN {head} || {tail} WHEN {i} % 29 = 0 THEN '{{"risk": }}'
      WHEN {i} % 31 = 0 THEN {head} || ', "reason": "Caller exhibits a scam pattern.", "flagged_spans": [1, 2]}}'
      WHEN {i} % 17 = 0 THEN {prose}
      WHEN {i} % 19 = 0 THEN {head} || ', "reason": 5' || {tail} ELSE {prose} END)"""


PARSED = f"""
gold AS (
  SELECT l.doc_id AS row_idx, l.toxic = 1 AS gold, l.quality, d.lang AS domain, d.source,
         d.text AS transcript
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
raws AS (
  SELECT *, {_raw('row_idx', 'gold')} AS raw, quality = 0 AS base_pred,
         (1 - quality) * 0.5::DOUBLE + (row_idx % 101) / 202::DOUBLE AS base_score
  FROM gold),
frags AS (SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}') AS frag FROM raws),
coded AS (
  SELECT *, CASE WHEN frag = '' THEN 'missing_json_object'
    WHEN NOT json_valid(frag) THEN 'malformed_json'
    WHEN json_type(frag, '$.risk') IS NULL OR json_type(frag, '$.fraud_type') IS NULL
      OR json_type(frag, '$.reason') IS NULL THEN 'missing_required_field'
    WHEN json_extract_string(frag, '$.risk') NOT IN ('low', 'medium', 'high') THEN 'invalid_enum'
    WHEN json_type(frag, '$.reason') <> 'VARCHAR' THEN 'invalid_reason'
    WHEN regexp_matches(frag, '"flagged_spans": \\[[0-9]') THEN 'invalid_flagged_spans' END AS failure
  FROM frags),
scored AS (
  SELECT *, failure IS NULL AS json_valid,
    CASE WHEN failure IS NULL THEN json_extract_string(frag, '$.risk') END AS risk,
    CASE WHEN failure IS NULL THEN json_extract_string(frag, '$.fraud_type') END AS fraud_type,
    CASE WHEN failure IS NULL THEN json_extract_string(frag, '$.reason') END AS reason,
    CASE WHEN failure IS NULL THEN json_array_length(frag, '$.flagged_spans')::INTEGER END AS spans,
    CASE WHEN failure IS NOT NULL AND frag <> '' AND json_valid(frag)
          AND json_extract_string(frag, '$.risk') IN ('low', 'medium', 'high')
         THEN json_extract_string(frag, '$.risk') END AS risk_hint
  FROM coded),
judged AS (
  SELECT *, coalesce(risk IN ('medium', 'high'), FALSE) AS pred,
    CASE risk WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
      AS score,
    CASE WHEN risk_hint IS NOT NULL THEN risk_hint IN ('medium', 'high')
         ELSE coalesce(risk IN ('medium', 'high'), FALSE) END AS fallback
  FROM scored)"""


def _rates(prefix: str = "", name: str = "") -> str:
    tp, fp, fn = f"{prefix}tp", f"{prefix}fp", f"{prefix}fn"
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 0 END)"
    return f"""round({p}, 9) AS {name}precision, round({r}, 9) AS {name}recall,
      round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 9) AS {name}f1"""


METRICS = f"""{PARSED},
rows_of AS (
  SELECT domain, 'llm' AS model, gold, pred, score, json_valid FROM judged
  UNION ALL
  SELECT domain, 'baseline', gold, base_pred, base_score, NULL FROM judged),
steps AS (
  SELECT domain, model, score, count(*) AS n, count(*) FILTER (gold) AS pos
  FROM rows_of GROUP BY ALL),
areas AS (
  SELECT domain, model, sum(pos * cp / cn) AS area FROM (
    SELECT *, (sum(n) OVER w)::DOUBLE AS cn, (sum(pos) OVER w)::DOUBLE AS cp FROM steps
    WINDOW w AS (PARTITION BY domain, model ORDER BY score DESC)) GROUP BY ALL),
conf AS (
  SELECT domain, model, count(*) AS n, count(*) FILTER (gold) AS pos,
    count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp,
    count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn,
    CASE WHEN model = 'llm' THEN count(*) FILTER (json_valid)::DOUBLE / count(*) END AS validity
  FROM rows_of GROUP BY domain, model),
metrics AS (
  SELECT c.domain, c.model, n, tp, fp, fn, tn, {_rates()},
    round(CASE WHEN pos > 0 THEN area / pos ELSE 0 END, 9) AS pr_auc,
    round(validity, 9) AS json_validity
  FROM conf c JOIN areas a ON c.domain = a.domain AND c.model = a.model)"""

SUMMARY_COUNTS = f"""
    count(*) AS n, count(*) FILTER (gold) AS gold_fraud, count(*) FILTER (NOT gold) AS gold_non_fraud,
    count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp,
    count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn,
    count(*) FILTER (gold AND fallback) AS fallback_tp,
    count(*) FILTER (NOT gold AND fallback) AS fallback_fp,
    count(*) FILTER (gold AND NOT fallback) AS fallback_fn,
    count(*) FILTER (NOT gold AND NOT fallback) AS fallback_tn,
    count(*) FILTER (gold AND base_pred) AS baseline_tp,
    count(*) FILTER (NOT gold AND base_pred) AS baseline_fp,
    count(*) FILTER (gold AND NOT base_pred) AS baseline_fn,
    count(*) FILTER (NOT gold AND NOT base_pred) AS baseline_tn,
    count(*) FILTER (NOT json_valid) AS invalid_total,
    count(*) FILTER (NOT json_valid AND gold) AS invalid_gold_fraud,
    count(*) FILTER (NOT json_valid AND NOT gold) AS invalid_gold_non_fraud,
    {", ".join(f"count(*) FILTER (failure = '{f}') AS invalid_{f}" for f in FAILURES)},
    count(*) FILTER (gold AND NOT pred AND json_valid) AS fn_valid_output,
    count(*) FILTER (gold AND NOT pred AND NOT json_valid) AS fn_invalid_output,
    count(*) FILTER (base_pred <> gold AND pred = gold) AS baseline_wrong_llm_correct,
    count(*) FILTER (risk_hint = 'low') AS hint_low,
    count(*) FILTER (risk_hint = 'medium') AS hint_medium,
    count(*) FILTER (risk_hint = 'high') AS hint_high"""

DOMINANT = """
fps AS (SELECT domain, raw, count(*) AS c, min(row_idx) AS first FROM judged
        WHERE NOT gold AND pred GROUP BY domain, raw),
dominant AS (
  SELECT domain, raw AS output, c AS count,
    round(c::DOUBLE / sum(c) OVER (PARTITION BY domain), 9) AS share_of_false_positives
  FROM fps QUALIFY row_number() OVER (PARTITION BY domain ORDER BY c DESC, first) = 1)"""

CATEGORY_ROWS = """
cats AS (
  SELECT domain, row_idx, gold, pred, json_valid, failure, unnest(list_filter([
      CASE WHEN gold AND pred THEN 'true_positive' WHEN gold THEN 'false_negative'
           WHEN pred THEN 'false_positive' ELSE 'true_negative' END,
      CASE WHEN NOT json_valid THEN 'invalid_json' END,
      CASE WHEN base_pred <> gold AND pred = gold THEN 'baseline_wrong_llm_correct' END],
    lambda x: x IS NOT NULL)) AS category
  FROM judged)"""


def _split_ctes(rows: str, key: str) -> str:
    """``rows`` is a relation with ``key`` and ``is_fraud``."""
    return f"""
base AS (SELECT *, sha256('42:' || {key}) AS h FROM {rows}),
cnt AS (SELECT is_fraud, count(*)::DOUBLE AS c FROM base GROUP BY is_fraud),
tot AS (SELECT sum(c) AS n, ceil(sum(c) * 0.15::DOUBLE) AS n_test FROM cnt),
q1 AS (SELECT is_fraud, c, n, n - n_test AS n_rest, (n - n_test) * c / n AS exact FROM cnt, tot),
q2 AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (
         ORDER BY exact - floor(exact) DESC, is_fraud) <= n_rest - sum(floor(exact)) OVER ()
         THEN 1 ELSE 0 END AS rest_q FROM q1),
q3 AS (SELECT *, n_rest - ceil(n_rest * (0.1::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE))) AS n_train
       FROM q2),
q4 AS (SELECT *, n_train * rest_q / n_rest AS exact2 FROM q3),
q5 AS (SELECT *, floor(exact2) + CASE WHEN row_number() OVER (
         ORDER BY exact2 - floor(exact2) DESC, is_fraud) <= n_train - sum(floor(exact2)) OVER ()
         THEN 1 ELSE 0 END AS train_q FROM q4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY h) AS rn FROM base),
split AS (
  SELECT r.*, CASE WHEN rn <= c - rest_q THEN 'test'
                   WHEN rn <= c - train_q THEN 'val' ELSE 'train' END AS split
  FROM ranked r JOIN q5 ON r.is_fraud = q5.is_fraud)"""


LABEL_SPLIT = (
    "lab AS (SELECT doc_id, toxic = 1 AS is_fraud FROM labels)," + _split_ctes("lab", "doc_id")
)

_EXACT = " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in CALL_TYPE_MAP.items())
_PART = " ".join(f"WHEN contains(kind, '{k}') THEN '{v}'" for k, v in CALL_TYPE_MAP.items())
CALL_TYPE_SQL = f"CASE {_EXACT} {_PART} ELSE 'other' END"


def _call_columns(scam: str) -> str:
    return f"""CASE WHEN {scam} THEN 'high' ELSE 'low' END AS risk,
    CASE WHEN {scam} THEN {CALL_TYPE_SQL} ELSE 'none' END AS fraud_type,
    CASE WHEN {scam} AND kind = '' THEN 'Caller exhibits a scam pattern.'
         WHEN {scam} THEN 'Caller exhibits a ' || kind || ' scam pattern.'
         WHEN kind = '' THEN 'No fraud indicators; appears to be a legitimate call.'
         ELSE 'No fraud indicators; appears to be a legitimate ' || kind || ' call.' END AS reason"""


REQUESTS = """
req AS (
  SELECT ts, 'POST' AS type, event_type AS name, event_type AS endpoint,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 503 ELSE 200 END AS status,
    event_type = 'error' AND event_id % 2 = 0 AS failed, event_id % 10 = 0 AS invalid,
    value > 35 AS is_fraud, value AS latency_ms, floor(epoch(ts))::BIGINT AS sec
  FROM events)"""


def _slid(length: int, step: int) -> str:
    return f"""
slid AS (SELECT *, unnest(range((sec // {step}) * {step} + {step},
                              (sec // {step}) * {step} + {length} + 1, {step})) AS t FROM req)"""


_PSI_RATE = "least(greatest(rate, 1e-6), 1 - 1e-6)"
PSI = f"""(({_PSI_RATE} - 0.5) * ln({_PSI_RATE} / 0.5)
  + ((1 - {_PSI_RATE}) - 0.5) * ln((1 - {_PSI_RATE}) / 0.5))"""
STATUS = f"""round(rate, 9) AS fraud_rate, round({PSI}, 9) AS psi, {PSI} > 0.25 AS alert"""

_STAMP = f"strftime(make_timestamp(({EPOCH_2026} + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S')"
_AT = f"CASE WHEN doc_id % 50 = 3 THEN {_STAMP} ELSE {_STAMP} || 'Z' END"
_EVT = "'evt-' || (CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END)"
_TXT = "CASE WHEN doc_id % 50 = 4 THEN '   ' ELSE text END"
EVENTS = f"""
body AS (
  SELECT doc_id, text, CASE WHEN doc_id % 50 = 5
    THEN to_json({{'event_id': {_EVT}, 'occurred_at': {_AT}, 'transcript': {_TXT}}})::VARCHAR
    ELSE to_json({{'event_id': {_EVT}, 'occurred_at': {_AT}, 'source': source,
                   'transcript': {_TXT}}})::VARCHAR END AS body FROM documents),
rec AS (
  SELECT 'calls-' || (doc_id % 3) AS stream_partition, doc_id // 3 AS source_offset, doc_id,
    CASE doc_id % 50 WHEN 2 THEN '{{' || text WHEN 6 THEN '[1, 2]'
      WHEN 7 THEN body || ' trailing' ELSE body END AS payload FROM body),
fields AS (
  SELECT *, json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.event_id') AS eid,
    json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.occurred_at') AS occ,
    json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.source') AS src,
    json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.transcript') AS txt
  FROM rec),
ev AS (
  SELECT *, CASE WHEN NOT json_valid(payload) THEN 'invalid_json'
    WHEN json_type(payload) <> 'OBJECT' THEN 'invalid_event::model_type'
    WHEN NOT regexp_matches(occ, '(Z|[+-]\\d\\d:\\d\\d)$') THEN 'invalid_event:occurred_at:value_error'
    WHEN src IS NULL THEN 'invalid_event:source:missing'
    WHEN length(txt) < 1 THEN 'invalid_event:transcript:string_too_short'
    WHEN length(txt) > 20000 THEN 'invalid_event:transcript:string_too_long'
    WHEN length({_strip('txt')}) = 0 THEN 'invalid_event:transcript:value_error' END AS error_code
  FROM fields),
outcome AS (
  SELECT *, CASE WHEN error_code IS NOT NULL THEN 'dead' WHEN row_number() OVER (
      PARTITION BY error_code IS NULL, eid ORDER BY stream_partition, source_offset) = 1
    THEN 'accepted' ELSE 'duplicate' END AS outcome FROM ev)"""
_EPOCH = "epoch(strptime(rtrim(occ, 'Z'), '%Y-%m-%dT%H:%M:%S'))::BIGINT"

FEATURE_ROWS = f"""
docs AS (
  SELECT d.doc_id, d.text, {_fp('d.text')} AS entity_id, l.toxic,
    CASE lang WHEN 'de' THEN 'test' WHEN 'fr' THEN 'val' ELSE 'train' END AS split,
    CASE lang WHEN 'de' THEN 2 WHEN 'fr' THEN 1 ELSE 0 END AS split_rank
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_LE = ", ".join(
    f"('{b}', {b}::DOUBLE)" if b != float("inf") else "('Infinity', 'Infinity'::DOUBLE)"
    for b in LATENCY_BOUNDS
)
_PCT = ", ".join(
    f"vs[least(floor(n * {p}::DOUBLE), n - 1)::BIGINT + 1] AS {percentile_name(p)}"
    for p in PERCENTILES
)
_ROUNDED = """(CASE WHEN latency_ms < 100 THEN round_even(latency_ms, 0)
      WHEN latency_ms < 1000 THEN round_even(latency_ms, -1)
      WHEN latency_ms < 10000 THEN round_even(latency_ms, -2)
      ELSE round_even(latency_ms, -3) END)::BIGINT"""

RAI = f"""
cases AS (
  SELECT *, domain AS candidate, (row_idx // 2)::VARCHAR AS pair_id,
    CASE row_idx % 3 WHEN 0 THEN 'benign_demographic' WHEN 1 THEN 'prompt_injection'
      ELSE 'other' END AS category,
    json_valid AND row_idx % 23 = 0 AND NOT contains(transcript, 'evidence not present') AS unsupported
  FROM judged),
two AS (
  SELECT candidate, count(*) AS pairs,
    count(*) FILTER (ok = 2 AND lo = hi) AS same FROM (
    SELECT candidate, pair_id, count(*) AS n, count(risk) AS ok, min(risk) AS lo, max(risk) AS hi
    FROM cases GROUP BY ALL) WHERE n = 2 GROUP BY candidate),
rai AS (
  SELECT c.candidate, count(*) AS n, coalesce(any_value(pairs), 0) AS counterfactual_pairs,
    coalesce(count(*) FILTER (json_valid)::DOUBLE / nullif(count(*), 0), 0) AS schema_validity,
    coalesce(count(*) FILTER (category = 'prompt_injection' AND gold AND pred)::DOUBLE
      / nullif(count(*) FILTER (category = 'prompt_injection' AND gold), 0), 1)
      AS prompt_injection_recall,
    coalesce(any_value(same)::DOUBLE / nullif(any_value(pairs), 0), 1) AS counterfactual_consistency,
    coalesce(count(*) FILTER (category = 'benign_demographic' AND NOT gold AND pred)::DOUBLE
      / nullif(count(*) FILTER (category = 'benign_demographic' AND NOT gold), 0), 0)
      AS benign_false_positive_rate,
    coalesce(count(*) FILTER (unsupported)::DOUBLE / nullif(count(*) FILTER (json_valid), 0), 0)
      AS unsupported_span_rate
  FROM cases c LEFT JOIN two ON c.candidate = two.candidate GROUP BY c.candidate),
rai_failed AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN NOT schema_validity >= 1 THEN 'schema_validity' END,
    CASE WHEN NOT prompt_injection_recall >= 1 THEN 'prompt_injection_recall' END,
    CASE WHEN NOT counterfactual_consistency >= 1 THEN 'counterfactual_consistency' END,
    CASE WHEN NOT benign_false_positive_rate <= 0 THEN 'benign_false_positive_rate' END,
    CASE WHEN NOT unsupported_span_rate <= 0 THEN 'unsupported_span_rate' END],
    lambda x: x IS NOT NULL), ',') AS failed_checks FROM rai)"""

_PROMPT_HEAD = SYSTEM_PROMPT + "\n\nTranscript:\n"
_PROMPT = f"('{_PROMPT_HEAD}' || text || '\n\nVerdict:')"
_DONE = f"""('{{"risk": "' || risk || '", "fraud_type": "' || fraud_type || '", "reason": "'
  || reason || '", "flagged_spans": []}}')"""
_TERMS = f"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS w FROM documents),
allterms AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
  FROM words)"""
_LONG = ", ".join(
    f"('{m}', {m}::DOUBLE)"
    for m in ("precision", "recall", "f1", "pr_auc", "json_validity", "n")
)
_SIDE = {
    "examples": "n::DOUBLE",
    "fraud_prevalence": "gold_fraud::DOUBLE / n",
    "precision": "precision",
    "recall": "recall",
    "f1": "f1",
    "json_validity": "(n - invalid_total)::DOUBLE / n",
    "false_positive_rate": "coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0)",
    "false_negative_rate": "coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0)",
    "invalid_output_rate": "invalid_total::DOUBLE / n",
    "fn_share_invalid_output": "coalesce(fn_invalid_output::DOUBLE / nullif(fn, 0), 0)",
    "dominant_fp_share": "coalesce(share_of_false_positives, 0)",
    "risk_only_f1": "fallback_f1",
}
_SIDE_ROWS = ", ".join(f"('{k}', {v})" for k, v in _SIDE.items())

ORACLE_SQL: dict[str, str] = {
    "language_profile": f"""
WITH c AS (
  SELECT doc_id, lang, text, {_fp('text')} AS fp FROM documents
  WHERE length({_strip('text')}) BETWEEN 1 AND 20000),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1),
f AS (SELECT lang, {_features('text')} FROM k)
SELECT lang, count(*) AS transcripts, round(avg(char_count), 9) AS avg_chars,
  round(avg(word_count), 9) AS avg_words, round(avg(turn_count), 9) AS avg_turns,
  round(avg(digit_ratio), 9) AS avg_digit_ratio, sum(has_url)::BIGINT AS with_url
FROM f GROUP BY lang""",
    "transcript_features": f"""
SELECT doc_id, {_fp('text')} AS entity_id, {_features('text')} FROM documents""",
    "text_excerpts": f"""
WITH n AS (SELECT doc_id, replace({_norm('text')}, '|', '\\|') AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE substr(s, 1, 179) || '…' END AS excerpt
FROM n""",
    "contract_quarantine": f"""
WITH {PAIRS} SELECT fingerprint, reason, transcript_chars::INTEGER AS transcript_chars
FROM routed WHERE reason IS NOT NULL""",
    "accepted_pairs": f"""
WITH {PAIRS} SELECT row_idx, fingerprint, risk FROM routed WHERE reason IS NULL""",
    "quality_report": f"""
WITH {PAIRS}, r AS (SELECT reason, count(*) AS n FROM routed WHERE reason IS NOT NULL GROUP BY reason)
SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS accepted_rows,
  count(*) FILTER (reason IS NOT NULL) AS rejected_rows,
  count(*) FILTER (reason = 'duplicate_transcript') AS duplicate_rows,
  count(error) AS contract_violations,
  round(count(error)::DOUBLE / greatest(count(*), 1), 9) AS contract_violation_ratio,
  (SELECT string_agg(reason || '=' || n, ';' ORDER BY reason) FROM r) AS rejection_reasons,
  count(error)::DOUBLE / greatest(count(*), 1) <= 0.01::DOUBLE AS passed
FROM routed""",
    "first_wins_dedup": f"""
SELECT doc_id, {_fp('text')} AS fingerprint, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY {_fp('text')} ORDER BY doc_id) = 1""",
    "intake_gate": """
SELECT source, count(*) AS items, count(*) FILTER (length(text) > 20000) AS texts_refused,
  count(*) FILTER (strlen(text) = 0 OR strlen(text) * 4096 > 25 * 1024 * 1024) AS recordings_refused
FROM documents GROUP BY source""",
    "corpus_union": f"""
WITH calls AS (
  SELECT 0 AS source_rank, d.doc_id AS row_idx, d.text, coalesce(l.toxic, 0) = 1 AS scam,
    lower({_strip('d.source')}) AS kind
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 1, conv_id * 1048576 + turn, text, turn % 2 = 1, lower({_strip('role')}) FROM conversations),
u AS (
  SELECT source_rank, row_idx, text, {_call_columns('scam')} FROM calls
  UNION ALL
  SELECT 2, page_id, html, CASE WHEN page_id % 3 = 0 THEN 'high' ELSE 'low' END,
    CASE WHEN page_id % 3 = 0 THEN 'other' ELSE 'none' END,
    CASE WHEN page_id % 3 = 0 THEN '{EMAIL_FRAUD_REASON}' ELSE '{EMAIL_LEGIT_REASON}' END FROM pages
  UNION ALL
  SELECT 3, item_id, text, CASE WHEN item_id % 2 = 1 THEN 'high' ELSE 'low' END,
    CASE WHEN item_id % 2 = 1 THEN 'other' ELSE 'none' END,
    CASE WHEN item_id % 2 = 1 THEN '{DOMAIN_FRAUD_REASON % "job scams"}'
         ELSE '{DOMAIN_LEGIT_REASON % "job scams"}' END FROM benchmark),
k AS (SELECT *, {_fp('text')} AS fingerprint FROM u)
SELECT source_rank, row_idx, fingerprint, risk, fraud_type, reason FROM k
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY source_rank, row_idx) = 1""",
    "call_taxonomy": f"""
WITH w AS (
  SELECT event_id, value > 35 AS is_scam, event_type,
    ({_list(CALL_TYPES)})[(event_id % {len(CALL_TYPES)})::INTEGER + 1] AS word FROM events),
t AS (
  SELECT is_scam, CASE event_id % 4 WHEN 0 THEN word WHEN 1 THEN '  ' || upper(word) || ' '
    WHEN 2 THEN event_type || ' ' || word END AS call_type FROM w),
k AS (SELECT *, lower({_strip("coalesce(call_type, '')")}) AS kind FROM t),
v AS (SELECT call_type, is_scam, {_call_columns('is_scam')} FROM k)
SELECT call_type, is_scam, risk, fraud_type, reason, count(*) AS n FROM v GROUP BY ALL""",
    "stratified_split": f"WITH {LABEL_SPLIT} SELECT doc_id, is_fraud, split FROM split",
    "split_manifest": f"""
WITH {LABEL_SPLIT} SELECT 'labels' AS dataset, split, count(*) AS n,
  round(avg(is_fraud::INTEGER), 9) AS fraud_ratio FROM split GROUP BY split""",
    "label_distribution": f"""
WITH {PAIRS}, lab AS (
  SELECT row_idx AS k, coalesce(has_verdict AND risk = 'high', FALSE) AS is_fraud,
    CASE WHEN has_verdict THEN fraud_type END AS fraud_type FROM pairs),
{_split_ctes('lab', 'k')}
SELECT split, fraud_type, count(*) AS n FROM split GROUP BY ALL""",
    "split_overlap": f"""
WITH lab AS (SELECT doc_id AS k, lang = 'en' AS is_fraud, {_fp('text')} AS fingerprint FROM documents),
{_split_ctes('lab', 'k')}
SELECT fingerprint FROM split GROUP BY fingerprint HAVING count(DISTINCT split) > 1""",
    "feature_upsert": f"""
WITH {FEATURE_ROWS}, both_of AS (
  SELECT *, 0 AS gen, 0 AS is_fraud FROM docs
  UNION ALL SELECT *, 1, toxic FROM docs WHERE toxic IS NOT NULL)
SELECT entity_id, 'v1' AS dataset_version, split, {_features('text')}, is_fraud FROM both_of
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY gen DESC, split_rank DESC, doc_id DESC) = 1""",
    "materialize_report": f"""
WITH {FEATURE_ROWS} SELECT 'documents' AS dataset_name, 'v1' AS dataset_version,
  count(*) AS materialized_rows, count(DISTINCT entity_id) AS stored_rows,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
  count(*) FILTER (split = 'test') AS test_rows FROM docs""",
    "feature_totals": f"""
WITH {FEATURE_ROWS}, k AS (SELECT * FROM docs WHERE toxic IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY entity_id ORDER BY split_rank DESC, doc_id DESC) = 1)
SELECT 'v1' AS dataset_version, sum(toxic)::BIGINT AS fraud_rows, count(*) AS rows FROM k""",
    "prompt_render": f"""
WITH k AS (SELECT conv_id, turn, text, turn % 2 = 1 AS scam, lower({_strip('role')}) AS kind
           FROM conversations),
v AS (SELECT conv_id, turn, text, {_call_columns('scam')} FROM k)
SELECT conv_id, turn, sha256({_PROMPT}) AS prompt_sha, {_DONE} AS completion,
  sha256({_PROMPT} || ' ' || {_DONE} || '</s>') AS training_sha,
  sha256({_PROMPT} || ' {{"risk": "') AS primed_sha FROM v""",
    "prompt_extract": """
SELECT conv_id, turn, sha256(text) AS transcript_sha FROM conversations""",
    "prediction_parse": f"""
WITH {PARSED} SELECT row_idx, failure, risk, fraud_type, reason, spans, risk_hint, pred, score
FROM judged""",
    "model_metrics": f"""
WITH {METRICS} SELECT *, NOT coalesce(f1 >= 0.7 AND pr_auc >= 0.6 AND json_validity >= 0.7, FALSE)
  AS gate_failed FROM metrics""",
    "metrics_long": f"""
WITH {METRICS}, l AS (
  SELECT domain, model, unnest([{_LONG.replace("('", "{'k': '").replace("', ", "', 'v': ").replace(")", "}")}]) AS m
  FROM metrics)
SELECT domain || '_' || model || '_' || m.k AS name, round(m.v, 9) AS value FROM l
WHERE m.v IS NOT NULL""",
    "champion": f"""
WITH {PARSED}, c AS (
  SELECT source, count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (NOT gold AND pred) AS fp,
    count(*) FILTER (gold AND NOT pred) AS fn FROM judged GROUP BY source),
r AS (SELECT regexp_extract(source, '(\\d+)', 1)::INTEGER AS version, {_rates()} FROM c)
SELECT 'control' AS model_name, version AS champion_version, f1 AS champion_f1 FROM r
QUALIFY row_number() OVER (ORDER BY f1 DESC, version DESC) = 1""",
    "error_rows": f"""
WITH {PARSED}, {CATEGORY_ROWS}, g AS (
  SELECT row_idx, string_agg(category, ',' ORDER BY CASE category WHEN 'invalid_json' THEN 1
    WHEN 'baseline_wrong_llm_correct' THEN 2 ELSE 0 END) AS categories FROM cats GROUP BY row_idx)
SELECT domain, j.row_idx AS index, gold AS gold_is_fraud, pred AS predicted_is_fraud, json_valid,
  failure AS invalid_reason, risk, fraud_type, base_pred AS baseline_predicted_is_fraud, categories
FROM judged j JOIN g ON j.row_idx = g.row_idx""",
    "error_summary": f"""
WITH {PARSED}, s AS (SELECT domain, {SUMMARY_COUNTS} FROM judged GROUP BY domain)
SELECT *, {_rates()}, {_rates('fallback_', 'fallback_')} FROM s""",
    "error_case_counts": f"""
WITH {PARSED}, {CATEGORY_ROWS} SELECT domain, category, count(*) AS n FROM cats GROUP BY ALL""",
    "invalid_reasons": f"""
WITH {PARSED} SELECT domain, failure AS reason, count(*) AS n FROM judged
WHERE failure IS NOT NULL GROUP BY ALL""",
    "dominant_false_positive": f"""
WITH {PARSED}, {DOMINANT} SELECT * FROM dominant""",
    "review_sample": f"""
WITH {PARSED}, {CATEGORY_ROWS}
SELECT category, row_idx, gold, pred, json_valid, failure FROM cats
WHERE category NOT IN ('true_positive', 'true_negative')
QUALIFY row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || row_idx), row_idx) <= 20""",
    "domain_comparison": f"""
WITH {PARSED}, {DOMINANT}, s AS (SELECT domain, {SUMMARY_COUNTS} FROM judged GROUP BY domain),
r AS (SELECT s.*, {_rates()}, {_rates('fallback_', 'fallback_')}, share_of_false_positives
      FROM s LEFT JOIN dominant d ON s.domain = d.domain),
l AS (SELECT r.domain, m.metric, m.value FROM r, LATERAL (VALUES {_SIDE_ROWS}) m(metric, value))
SELECT metric, domain, round(value, 9) AS value FROM l""",
    "rai_checks": f"""
WITH {PARSED}, {RAI}
SELECT candidate, round(schema_validity, 9) AS schema_validity,
  round(prompt_injection_recall, 9) AS prompt_injection_recall,
  round(counterfactual_consistency, 9) AS counterfactual_consistency,
  round(benign_false_positive_rate, 9) AS benign_false_positive_rate,
  round(unsupported_span_rate, 9) AS unsupported_span_rate, n, counterfactual_pairs,
  failed_checks = '' AS passed, failed_checks FROM rai_failed""",
    "promotion_gate": f"""
WITH {METRICS}, {RAI}, ops AS (
  SELECT lang, quantile_cont(value, 0.95) AS p95,
    count(*) FILTER (event_type = 'error' AND event_id % 2 = 0)::DOUBLE / count(*) AS err
  FROM events JOIN documents ON event_id = doc_id GROUP BY lang),
e AS (
  SELECT c.lang AS candidate, array_to_string(list_filter([
    CASE WHEN NOT coalesce(f1 >= 0.85, FALSE) THEN 'f1' END,
    CASE WHEN NOT coalesce(pr_auc >= 0.85, FALSE) THEN 'pr_auc' END,
    CASE WHEN NOT coalesce(m.json_validity >= 0.94, FALSE) THEN 'json_validity' END,
    CASE WHEN NOT coalesce(p95 <= 2000, FALSE) THEN 'p95_latency_ms' END,
    CASE WHEN NOT coalesce(err <= 0.02, FALSE) THEN 'error_rate' END,
    CASE WHEN NOT coalesce(r.failed_checks = '', FALSE) THEN 'responsible_ai' END],
    lambda x: x IS NOT NULL), ',') AS failed_checks
  FROM (SELECT lang FROM documents UNION SELECT role FROM conversations) c
  LEFT JOIN metrics m ON m.domain = c.lang AND m.model = 'llm'
  LEFT JOIN ops ON ops.lang = c.lang LEFT JOIN rai_failed r ON r.candidate = c.lang)
SELECT candidate, CASE WHEN failed_checks = '' THEN 'promote' ELSE 'reject' END AS decision,
  failed_checks = '' AS passed, failed_checks FROM e""",
    "retry_resolution": f"""
SELECT doc_id AS request_id,
  CASE WHEN doc_id % 5 > 2 THEN 'medium' WHEN toxic = 1 THEN 'high' ELSE 'low' END AS risk,
  CASE WHEN doc_id % 5 > 2 THEN '{FALLBACK_REASON}' ELSE 'attempt ' || (doc_id % 5) END AS reason,
  doc_id % 5 > 2 AS used_fallback, least(doc_id % 5, 3)::BIGINT AS invalid_attempts FROM labels""",
    "drift_rolling": f"""
WITH r AS (
  SELECT event_type AS key, event_id,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos,
    count(*) OVER w AS window_size, avg((value > 35)::INTEGER) OVER w AS rate FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT key, event_id, pos, window_size, {STATUS} FROM r""",
    "drift_status": f"""
WITH l AS (SELECT event_type AS key, value > 35 AS f FROM events QUALIFY row_number() OVER (
  PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200),
r AS (SELECT key, count(*) AS window_size, avg(f::INTEGER) AS rate FROM l GROUP BY key)
SELECT key, window_size, {STATUS} FROM r""",
    "request_counts": f"""
WITH {REQUESTS} SELECT endpoint, status, count(*) AS requests FROM req GROUP BY ALL""",
    "latency_histogram": f"""
WITH {REQUESTS}, b(le, bound) AS (VALUES {_LE}), e AS (SELECT DISTINCT endpoint FROM req)
SELECT e.endpoint, b.le, (SELECT count(*) FROM req
  WHERE req.endpoint = e.endpoint AND latency_ms / 1000 <= b.bound) AS requests FROM e, b""",
    "request_rate": f"""
WITH {REQUESTS}, {_slid(60, 5)}
SELECT status, t, round(count(*) / 60.0::DOUBLE, 9) AS rate FROM slid GROUP BY ALL""",
    "invalid_rate": f"""
WITH {REQUESTS}, {_slid(300, 5)}
SELECT t, round(count(*) FILTER (invalid) / 300.0::DOUBLE, 9) AS rate FROM slid GROUP BY ALL""",
    "latency_p95": f"""
WITH {REQUESTS}, {_slid(300, 5)}, b(le, bound) AS (VALUES {_LE}),
h AS (SELECT endpoint, t, bound, count(*) FILTER (latency_ms / 1000 <= bound) AS c,
        count(*) AS n FROM slid, b GROUP BY endpoint, t, bound),
p AS (SELECT *, lag(c, 1, 0) OVER w AS pc, lag(bound, 1, 0::DOUBLE) OVER w AS pb FROM h
      WINDOW w AS (PARTITION BY endpoint, t ORDER BY bound))
SELECT endpoint, t, round(CASE WHEN isinf(bound) THEN pb
  ELSE pb + (bound - pb) * (n * 0.95::DOUBLE - pc) / (c - pc) END, 9) AS latency_seconds
FROM p WHERE c >= n * 0.95::DOUBLE
QUALIFY row_number() OVER (PARTITION BY endpoint, t ORDER BY bound) = 1""",
    "latency_table": f"""
WITH {REQUESTS}, u AS (
  SELECT type, name, ts, latency_ms, failed FROM req
  UNION ALL SELECT '', 'Aggregated', ts, latency_ms, failed FROM req),
s AS (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE AS span FROM req),
g AS (
  SELECT type, name, count(*) AS n, count(*) FILTER (failed) AS f, list_sort(list({_ROUNDED})) AS vs,
    avg(latency_ms) AS mean, min(latency_ms) AS lo, max(latency_ms) AS hi FROM u GROUP BY type, name)
SELECT type, name, n AS request_count, f AS failure_count,
  vs[floor((n - 1) / 2)::BIGINT + 1] AS median_ms, round(mean, 6) AS mean_ms,
  round(lo, 6) AS min_ms, round(hi, 6) AS max_ms, round(n / span, 6) AS requests_per_s,
  round(f / span, 6) AS failures_per_s, {_PCT} FROM g, s""",
    "live_rates": f"""
WITH {REQUESTS} SELECT (sec // 60) * 60 AS window_start, endpoint AS key, count(*) AS requests,
  count(*) FILTER (status >= 500) AS errors, count(*) FILTER (invalid) AS invalid,
  round(avg(is_fraud::INTEGER), 9) AS fraud_rate FROM req GROUP BY ALL""",
    "event_contract": f"""
WITH {EVENTS}, v AS (SELECT *, CASE WHEN error_code IS NULL THEN txt END AS good FROM ev)
SELECT stream_partition, source_offset, error_code,
  CASE WHEN error_code IS NULL THEN eid END AS event_id,
  CASE WHEN error_code IS NULL THEN {_EPOCH} END AS occurred_at, {_fp('good')} AS transcript_hash,
  word_count, digit_ratio FROM (
    SELECT *, {_features('good')} FROM v)""",
    "stream_curated": f"""
WITH {EVENTS} SELECT eid AS event_id, stream_partition, source_offset, {_EPOCH} AS occurred_at,
  src AS source, {_fp('txt')} AS transcript_hash, {_features('txt')} FROM outcome
WHERE outcome = 'accepted'""",
    "stream_dead_letter": f"""
WITH {EVENTS} SELECT stream_partition, source_offset, sha256(payload) AS payload_hash, error_code
FROM outcome WHERE outcome = 'dead'""",
    "stream_stats": f"""
WITH {EVENTS} SELECT stream_partition, count(*) AS processed,
  count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'dead') AS dead_lettered,
  count(*) FILTER (outcome = 'duplicate') AS duplicates, 0::BIGINT AS skipped_by_checkpoint,
  max(source_offset) + 1 AS next_offset FROM outcome GROUP BY stream_partition""",
    "tfidf_terms": f"""
WITH {_TERMS}, c AS (
  SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM allterms GROUP BY term
  HAVING count(DISTINCT doc_id) >= 2)
SELECT term, tf, df, round(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1, 9) AS idf
FROM c ORDER BY tf DESC, term LIMIT 20000""",
}
ORACLE_SQL["stream_drift"] = ORACLE_SQL["drift_status"]
ORACLE_SQL["drift_rolling_short"] = ORACLE_SQL["drift_rolling"].replace("199 PRECEDING", "9 PRECEDING")
ORACLE_SQL["corpus_from_files"] = ORACLE_SQL["corpus_union"]
ORACLE_SQL["feature_store"] = ORACLE_SQL["feature_upsert"]
ORACLE_SQL["stream_resume"] = ORACLE_SQL["stream_stats"]
ORACLE_SQL["predictions_roundtrip"] = "SELECT doc_id AS row_idx, lang, sha256(text) AS raw_sha FROM documents"
ORACLE_SQL["predictions_in_order"] = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, sha256(text) AS raw_sha FROM documents"""
ORACLE_SQL["operational_metrics"] = """
SELECT lang AS candidate, round(quantile_cont(value, 0.95), 9) AS p95_latency_ms,
  round(count(*) FILTER (event_type = 'error' AND event_id % 2 = 0)::DOUBLE / count(*), 9) AS error_rate
FROM events JOIN documents ON event_id = doc_id GROUP BY lang"""
ORACLE_SQL["tfidf_weights"] = f"""
WITH {_TERMS}, v AS (
  SELECT term, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM allterms GROUP BY term
  HAVING count(DISTINCT doc_id) >= 2 ORDER BY count(*) DESC, term LIMIT 20000),
w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM allterms JOIN v USING (term) GROUP BY doc_id, term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w"""
ORACLE_SQL["stream_growing_file"] = f"""
WITH {EVENTS}, placed AS (
  SELECT *, row_number() OVER (ORDER BY source_offset % 3, source_offset, stream_partition) - 1 AS line FROM ev),
kept AS (SELECT * FROM placed WHERE error_code IS NULL QUALIFY row_number() OVER (PARTITION BY eid ORDER BY line) = 1)
SELECT eid AS event_id, line AS source_offset, {_EPOCH} AS occurred_at, {_fp('txt')} AS transcript_hash, length(txt)::INTEGER AS char_count
FROM kept"""
ORACLE_SQL["feature_lookups"] = f"""
WITH {FEATURE_ROWS}, latest AS (
  SELECT entity_id, split, {_features('text')}, toxic AS is_fraud FROM docs WHERE toxic IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY split_rank DESC, doc_id DESC) = 1),
stored AS (
  SELECT *, 'v1' AS dataset_version FROM latest UNION ALL SELECT *, 'v2' FROM latest WHERE is_fraud = 1)
SELECT entity_id, dataset_version, split, word_count, is_fraud::INTEGER AS is_fraud FROM stored
WHERE (dataset_version = 'v1' AND split = 'test' AND is_fraud = 1) OR (dataset_version = 'v2' AND split = 'train')
  OR (dataset_version = 'v2' AND split = 'val' AND is_fraud = 0)"""
ORACLE_SQL["incremental_dedup"] = f"""
SELECT doc_id, {_fp('text')} AS fingerprint, (doc_id % 2)::INTEGER AS drop FROM documents
QUALIFY row_number() OVER (PARTITION BY {_fp('text')} ORDER BY doc_id % 2, doc_id) = 1"""
ORACLE_SQL["quarantine_written"] = ORACLE_SQL["contract_quarantine"]
ORACLE_SQL["errors_written"] = ORACLE_SQL["error_rows"]
ORACLE_SQL["metrics_written"] = ORACLE_SQL["metrics_long"]
ORACLE_SQL["report_written"] = f"""
SELECT input_rows, accepted_rows, contract_violation_ratio, passed, CASE WHEN passed THEN '' ELSE
  'data quality gate failed: contract_violation_ratio=' || printf('%.4f', contract_violation_ratio) || ' exceeds 0.0100' END AS stopped
FROM ({ORACLE_SQL["quality_report"]})"""
ORACLE_SQL["examples_written"] = f"""
WITH {PAIRS} SELECT row_idx, sha256(transcript) AS transcript_sha, risk, risk IN ('medium', 'high') AS gold FROM routed WHERE reason IS NULL"""
ORACLE_SQL["cases_written"] = f"SELECT candidate, n, counterfactual_pairs, passed, failed_checks FROM ({ORACLE_SQL['rai_checks']})"
ORACLE_SQL["split_file_digests"] = f"""
WITH {LABEL_SPLIT}, f AS (SELECT split, string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10) AS body FROM split GROUP BY split),
b AS (SELECT split, length(body) AS length, i, sha256(substr(body, i * 4096 + 1, 4096)) AS digest FROM f, range(0, (length(body) + 4095) // 4096) AS r(i))
SELECT split, length, CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(unhex(string_agg(digest, '' ORDER BY i))) END AS sha256
FROM b GROUP BY split, length"""
