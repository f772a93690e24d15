import json
from datetime import datetime

from pyspark.sql import functions as F

from callsieve.functions import contract as C
from callsieve.schemas import QualityPolicy


def event(**changes):
    body = {"event_id": "e", "occurred_at": "2026-07-23T10:00:00Z", "source": "s", "transcript": "t"}
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v != "<absent>"})


AT = "invalid_event:occurred_at:"
EVENTS = [
    (event(), None), ("{not json", "invalid_json"), ("", "invalid_json"), ("{} {}", "invalid_json"),
    ("[1]", "invalid_event::model_type"), ("null", "invalid_event::model_type"), ("5", "invalid_event::model_type"),
    ("{}", "invalid_event:event_id:missing"),
    (event(event_id=""), "invalid_event:event_id:string_too_short"),
    (event(event_id="  "), "invalid_event:event_id:value_error"),
    (event(event_id=5), "invalid_event:event_id:string_type"),
    (event(event_id="x" * 129), "invalid_event:event_id:string_too_long"),
    (event(source="x" * 65), "invalid_event:source:string_too_long"),
    (event(source=None), "invalid_event:source:string_type"),
    (event(transcript="<absent>"), "invalid_event:transcript:missing"),
    (event(transcript=""), "invalid_event:transcript:string_too_short"),
    (event(transcript="x" * 20001), "invalid_event:transcript:string_too_long"),
    (event(transcript="x" * 20000), None),
    (event(occurred_at="<absent>"), AT + "missing"), (event(occurred_at=None), AT + "datetime_type"),
    (event(occurred_at=True), AT + "datetime_type"), (event(occurred_at=[]), AT + "datetime_type"),
    (event(occurred_at="2026-07-23T10:00:00"), AT + "value_error"),
    (event(occurred_at="2026-07-23"), AT + "value_error"),
    (event(occurred_at="not a date"), AT + "datetime_from_date_parsing"),
    (event(occurred_at="2026-02-30T10:00:00Z"), AT + "datetime_from_date_parsing"),
    (event(occurred_at="2026-07-23T24:00:00Z"), AT + "datetime_from_date_parsing"),
    (event(occurred_at="2026-07-23T10:00:00+24:00"), AT + "datetime_from_date_parsing"),
    (event(occurred_at="0000-01-01T00:00:00Z"), AT + "datetime_parsing"),
    (event(occurred_at=1e20), AT + "datetime_parsing"),
    (event(occurred_at="2026-07-23T10:00:00", source=""), AT + "value_error"),
]
TIMES = [
    ("2026-07-23T10:00:00Z", datetime(2026, 7, 23, 10)),
    ("2026-07-23_10:00z", datetime(2026, 7, 23, 10)),
    ("2026-07-23 10:00+0530", datetime(2026, 7, 23, 4, 30)),
    ("2026-07-23T10:00:00.123456789-01:00", datetime(2026, 7, 23, 11, 0, 0, 123456)),
    ("2026-07-23T10:00:00,5Z", datetime(2026, 7, 23, 10, 0, 0, 500000)),
    ("2026-07-23T10:00:00+23:59", datetime(2026, 7, 22, 10, 1)),
    ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
    (1700000000, datetime(2023, 11, 14, 22, 13, 20)),
    (1700000000000, datetime(2023, 11, 14, 22, 13, 20)),
    (1.5, datetime(1970, 1, 1, 0, 0, 1, 500000)),
    ("-5", datetime(1969, 12, 31, 23, 59, 55)),
]


def test_event_contract_codes(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(EVENTS)], "i int, payload string")
    for r in C.with_event(df).collect():
        assert r.error_code == EVENTS[r.i][1], EVENTS[r.i]
        assert (r.event is None) == (r.error_code is not None)


def test_event_times(spark):
    df = spark.createDataFrame([(i, event(occurred_at=t)) for i, (t, _) in enumerate(TIMES)], "i int, payload string")
    for r in C.with_event(df).select("i", F.col("event.occurred_at").alias("t")).collect():
        assert r.t == TIMES[r.i][1], TIMES[r.i]


def test_pair_contract_first_rule_wins(spark):
    ok = ("low", "none", "r", [])
    cases = [
        ("a", ok, None), (None, ok, "transcript_not_string"), ("  ", ok, "transcript_too_short"),
        ("x" * 11, ok, "transcript_too_long"), (" " + "x" * 10 + " ", ok, None), ("a", None, "verdict_not_object"),
        ("a", ("huge", "none", "r", []), "invalid_verdict_schema"),
        ("a", ("low", "none", "", []), "invalid_verdict_schema"),
        ("a", ("low", "none", "r", ["a", None]), "invalid_verdict_schema"),
        ("a", ("low", "other", "r", []), "inconsistent_low_risk_fraud_type"),
        ("a", ("medium", "none", "r", []), "inconsistent_fraud_risk_type"),
        ("a b", ("high", "other", "r", ["c"]), "flagged_span_not_verbatim"),
        ("a b", ("high", "other", "r", ["a", ""]), None),
    ]
    schema = "i int, t string, v struct<risk: string, fraud_type: string, reason: string, flagged_spans: array<string>>"
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], schema)
    error = C.pair_contract(F.col("t"), F.col("v"), QualityPolicy(max_transcript_chars=10))
    for r in df.select("i", error.alias("e")).collect():
        assert r.e == cases[r.i][2], cases[r.i]


def test_intake_limits(spark):
    df = spark.createDataFrame([("x" * 20000, 0), ("x" * 20001, 26214401), ("y", 26214400)], "t string, n long")
    rows = df.select(C.text_intake(F.col("t")).alias("t"), C.audio_intake(F.col("n")).alias("a")).collect()
    assert [(r.t, r.a) for r in rows] == [
        (None, "audio_empty"), ("transcript_too_large", "audio_too_large"), (None, None),
    ]
