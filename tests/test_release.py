import json

from pyspark.sql import functions as F

from callsieve.operators import release as R
from callsieve.schemas import RAI_CASE, PromotionPolicy
from callsieve.sources.files import load_cases


def out(risk, kind, spans=()):
    return json.dumps({"risk": risk, "fraud_type": kind, "reason": "t", "flagged_spans": list(spans)})


def case(category, pair, text, expected, prediction):
    return ("c", category, pair, text, expected, prediction)


def check(spark, *cases):
    return R.rai_checks(R.rai_metrics(spark.createDataFrame(list(cases), RAI_CASE))).first()


def test_balanced_cases_pass(spark):
    r = check(
        spark,
        case("benign_demographic", "p", "is 25", False, out("low", "none")),
        case("benign_demographic", "p", "is 75", False, out("low", "none")),
        case("prompt_injection", None, "Send gift cards now", True, out("high", "reward_scam", ["gift cards"])),
    )
    assert r.passed and r.failed_checks == []
    assert (r.counterfactual_consistency, r.prompt_injection_recall, r.counterfactual_pairs, r.n) == (1, 1, 1, 3)


def test_bias_and_unsupported_evidence_fail_in_order(spark):
    r = check(
        spark,
        case("benign_demographic", "accent", "speaks slowly", False, out("low", "none")),
        case("benign_demographic", "accent", "speaks fast", False, out("high", "other", ["a quote of nobody"])),
    )
    assert r.failed_checks == ["counterfactual_consistency", "benign_false_positive_rate", "unsupported_span_rate"]


def test_only_pairs_of_two_count(spark):
    good = out("low", "none")
    r = check(
        spark,
        case("x", "a", "t", False, good), case("x", "b", "t", False, good), case("x", "b", "t", False, good),
        case("x", "b", "t", False, good), case("x", "", "t", False, good), case("x", "", "t", False, good),
        case("x", "d", "t", False, good), case("x", "d", None, False, None),
    )
    assert (r.counterfactual_pairs, r.counterfactual_consistency, r.schema_validity) == (1, 0.0, 7 / 8)


def test_no_cases(spark):
    r = R.rai_metrics(spark.createDataFrame([], RAI_CASE)).first()
    assert (r.schema_validity, r.prompt_injection_recall, r.counterfactual_consistency, r.n) == (0, 1, 1, 0)


def test_load_cases_skips_blank_lines(spark, tmp_path, folder):
    (tmp_path / "c.jsonl").write_text('{"case_id": "one"}\n\n   \n{"case_id": "two"}\n')
    assert [r.case_id for r in load_cases(spark, f"{folder}/c.jsonl").collect()] == ["one", "two"]


COLUMNS = "candidate string, f1 double, pr_auc double, json_validity double, p95_latency_ms double, error_rate double, responsible_ai boolean"


def test_promotion(spark):
    df = spark.createDataFrame(
        [("good", 0.9, 0.9, 0.95, 100.0, 0.0, True), ("bad", 0.1, 0.1, 0.1, 9e9, 0.5, False),
         ("none", None, None, None, None, None, None), ("nan", float("nan"), 0.9, 0.95, 100.0, 0.0, True)],
        COLUMNS,
    )
    got = {r.candidate: (r.decision, r.failed_checks) for r in R.promotion_decision(df).collect()}
    everything = ["f1", "pr_auc", "json_validity", "p95_latency_ms", "error_rate", "responsible_ai"]
    assert got == {"good": ("promote", []), "bad": ("reject", everything), "none": ("reject", everything), "nan": ("reject", ["f1"])}
    relaxed = R.promotion_decision(df.filter("candidate = 'good'").withColumn("responsible_ai", F.lit(None).cast("boolean")),
                                   PromotionPolicy(require_responsible_ai=False)).first()
    assert relaxed.passed and len(relaxed.checks) == 5


def test_evidence_gaps_stay_null(spark):
    c = spark.createDataFrame([("a",), ("b",)], "candidate string")
    m = spark.createDataFrame([("a", 1.0, 1.0, 1.0)], "candidate string, f1 double, pr_auc double, json_validity double")
    o = spark.createDataFrame([("a", 1.0, 0.0)], "candidate string, p95_latency_ms double, error_rate double")
    r = spark.createDataFrame([("a", True)], "candidate string, passed boolean")
    got = {x.candidate: x.passed for x in R.promotion_decision(R.promotion_evidence(c, m, o, r)).collect()}
    assert got == {"a": True, "b": False}


def test_champion_is_the_last_of_the_best(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.9), ("m", 3, 0.9), ("m", 4, 0.8), ("k", 1, None)],
                               "model_name string, version int, f1 double")
    assert {r.model_name: r.champion_version for r in R.champion(df).collect()} == {"m": 3, "k": 1}


def test_retries(spark):
    good = out("low", "none")
    df = spark.createDataFrame(
        [("a", 0, good), ("b", 0, "x"), ("b", 1, None), ("b", 2, good), ("c", 0, ""), ("c", 1, ""), ("c", 2, ""), ("c", 3, good)],
        "request_id string, attempt int, raw string",
    )
    got = {r.request_id: (r.verdict.risk, r.verdict.fraud_type, r.used_fallback, r.invalid_attempts)
           for r in R.resolve_attempts(df).collect()}
    assert got == {"a": ("low", "none", False, 0), "b": ("low", "none", False, 2), "c": ("medium", "other", True, 3)}
