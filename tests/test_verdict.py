import json

import pytest
from pyspark.sql import functions as F

from callsieve.functions import verdict as V
from callsieve.functions.text import extract_transcript

BODY = '"fraud_type":"other","reason":"x"'
CASES = [
    ("I cannot judge this call.", "missing_json_object", None),
    (None, "missing_json_object", None),
    ('Answer: {"reason": "cut off', "missing_json_object", None),
    ("} {", "missing_json_object", None),
    ('{"risk": low, "reason": "bare word"}', "malformed_json", None),
    ('{"risk":"high",%s} {"a":1}' % BODY, "malformed_json", None),
    ('{"risk":"high",%s},{"a":1}' % BODY, "malformed_json", None),
    ('{"risk":"high",%s},null}' % BODY, "malformed_json", None),
    ("{'risk':'high'}", "malformed_json", None),
    ('{"risk":"high",%s,}' % BODY, "malformed_json", None),
    ('{"risk":"medium","fraud_type":"none"}', "missing_required_field", "medium"),
    ('{"risk":"HIGH"}', "missing_required_field", None),
    ('{"risk":"unclear",%s}' % BODY, "invalid_enum", None),
    ('{"risk":" high",%s}' % BODY, "invalid_enum", None),
    ('{"risk":null,%s}' % BODY, "invalid_enum", None),
    ('{"risk":1,%s}' % BODY, "invalid_enum", None),
    ('{"risk":"high","fraud_type":"x","reason":""}', "invalid_enum", "high"),
    ('{"risk":"low","fraud_type":"none","reason":""}', "invalid_reason", "low"),
    ('{"risk":"low","fraud_type":"other","reason":5}', "invalid_reason", "low"),
    ('{"risk":"high",%s,"flagged_spans":null}' % BODY, "invalid_flagged_spans", "high"),
    ('{"risk":"high",%s,"flagged_spans":[1]}' % BODY, "invalid_flagged_spans", "high"),
    ('{"risk":"high",%s,"flagged_spans":[null]}' % BODY, "invalid_flagged_spans", "high"),
    ('{"risk":"high",%s,"flagged_spans":["a",null]}' % BODY, "invalid_flagged_spans", "high"),
    ('{"risk":"high",%s,"flagged_spans":"a"}' % BODY, "invalid_flagged_spans", "high"),
]
GOOD = [
    ('pre {"risk":"high",%s,"flagged_spans":["a"]} post' % BODY, ("high", ["a"])),
    ('```json\n{"risk":"low",%s}\n```' % BODY, ("low", [])),
    ('{"risk":"medium","fraud_type":"other","reason":" ","flagged_spans":[],"more":{"k":[1]}}', ("medium", [])),
    ('{"risk":"low","risk":"high",%s}' % BODY, ("high", [])),
]


def test_failure_taxonomy_and_hints(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    for r in V.with_verdict(df).collect():
        assert (r.failure, r.risk_hint) == CASES[r.i][1:], CASES[r.i]
        assert r.verdict is None


def test_valid_outputs(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(GOOD)], "i int, raw string")
    for r in V.with_verdict(df).collect():
        assert r.failure is None and r.risk_hint is None
        assert (r.verdict.risk, r.verdict.flagged_spans) == GOOD[r.i][1]


def test_accepted_divergences(spark):
    """Known and kept: NaN in an ignored key is refused, a lone surrogate is not."""
    raws = ['{"risk":"low",%s,"z":NaN}' % BODY, '{"risk":"low","fraud_type":"none","reason":"\\ud800"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r.failure for r in V.with_verdict(df).collect()}
    assert got == {0: "malformed_json", 1: None}


@pytest.mark.parametrize(
    "kind,expected",
    [
        ("ssn", "ssn_scam"), ("Tech_Support", "tech_support_scam"), ("  GIFT ", "reward_scam"),
        ("bank refund", "refund_scam"), ("first class", "impersonation"), ("government", "impersonation"),
        ("delivery", "other"), ("", "other"), (None, "other"), ("support line", "tech_support_scam"),
    ],
)
def test_call_taxonomy(spark, kind, expected):
    df = spark.createDataFrame([(kind,)], "k string")
    assert df.select(V.fraud_type_of_call(F.col("k")).alias("t")).first().t == expected


def test_label_mappings(spark):
    df = spark.createDataFrame([("ssn", "FRAUD ", 1, "job_scams"), (None, "NOT_FRAUD", 0, "sms")],
                               "kind string, label string, flag int, domain string")
    rows = df.select(
        V.call_verdict(F.col("flag") == 1, F.col("kind")).alias("call"),
        V.email_verdict(F.col("label")).alias("mail"),
        V.domain_verdict(F.col("flag"), F.col("domain")).alias("dom"),
    ).collect()
    assert rows[0].call.fraud_type == "ssn_scam" and rows[0].call.risk == "high"
    assert rows[0].call.reason == "Caller exhibits a ssn scam pattern."
    assert rows[1].call.reason == "No fraud indicators; appears to be a legitimate call."
    assert "None" not in rows[1].call.reason
    assert (rows[0].mail.risk, rows[0].mail.fraud_type) == ("high", "other")
    assert (rows[1].mail.risk, rows[1].mail.fraud_type) == ("low", "none")
    assert rows[0].dom.reason == "Cross-domain job scams text labeled deceptive."
    assert rows[1].dom.flagged_spans == []


def test_render_round_trip(spark):
    text = 'He said "pay", é\U0001f600\nnow\t!'
    df = spark.createDataFrame([(text,)], "t string").select(
        "t", V.make_verdict("high", "other", F.lit('why "x"\n'), F.array(F.lit("pay"), F.lit("é"))).alias("v")
    )
    out = df.select(
        V.render_prompt(F.col("t")).alias("prompt"), V.render_completion(F.col("v")).alias("completion")
    )
    r = out.select(
        "*", extract_transcript(F.col("prompt")).alias("back"),
        V.training_text(F.col("prompt"), F.col("completion"), "<eos>").alias("sft"),
        V.restore_primer(F.lit("high")).alias("restored"),
    ).first()
    assert r.back == text
    expected = {"risk": "high", "fraud_type": "other", "reason": 'why "x"\n', "flagged_spans": ["pay", "é"]}
    assert r.completion == json.dumps(expected, ensure_ascii=False)
    assert r.sft.count("\n\nVerdict:") == 1 and r.sft.endswith("}<eos>")
    assert r.restored == '{"risk": "high'
