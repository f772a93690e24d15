import pytest
from pyspark.sql import functions as F

from callsieve.operators import errors, evaluate
from callsieve.schemas import METRICS_REPORT, RegressionFloors
from callsieve.sources.files import read_document

FRAUD = '{"risk":"high","fraud_type":"other","reason":"x","flagged_spans":[]}'
LEGIT = '{"risk":"low","fraud_type":"none","reason":"x","flagged_spans":[]}'


def scored(spark, data):
    df = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(data)], "row_idx long, raw string, gold boolean")
    return evaluate.score_outputs(df).withColumn("domain", F.lit("id"))


@pytest.mark.parametrize(
    "tp,fp,fn,tn,expected",
    [
        (608, 9, 67, 666, (0.985413290113452, 0.9007407407407407, 0.9411764705882353, 0.937231526502191)),
        (740, 247, 116, 823, (0.7497467071935157, 0.8644859813084113, 0.8030385241454151, 0.7083739706527536)),
    ],
)
def test_published_confusions(spark, tp, fp, fn, tn, expected):
    i, n = F.col("id"), tp + fp + fn + tn
    df = spark.range(n).select(
        F.lit("d").alias("domain"), ((i < tp) | ((i >= tp + fp) & (i < tp + fp + fn))).alias("gold"),
        (i < tp + fp).alias("pred"),
    ).withColumn("score", F.col("pred").cast("double"))
    r = evaluate.binary_metrics(df, ["domain"]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
    assert (r.precision, r.recall, r.f1, r.pr_auc) == pytest.approx(expected, abs=1e-12)
    assert r.json_validity is None


def test_continuous_scores_equal_the_step_sum(spark):
    df = spark.range(3000).select(
        (F.col("id") % 2).cast("string").alias("domain"), (F.hash("id") % 5 == 0).alias("gold"),
        (F.pmod(F.hash(F.col("id") * 3), F.lit(977)) / 1000.0).alias("score"),
    ).withColumn("pred", F.col("score") > 0.5)
    got = {r.domain: r.pr_auc for r in evaluate.binary_metrics(df, ["domain"]).collect()}
    data = df.collect()
    for domain in ("0", "1"):
        mine = [(r.score, r.gold) for r in data if r.domain == domain]
        pos, area, seen, hit = sum(g for _, g in mine), 0.0, 0, 0
        for s in sorted({s for s, _ in mine}, reverse=True):
            step = [g for t, g in mine if t == s]
            seen, hit = seen + len(step), hit + sum(step)
            area += sum(step) / pos * hit / seen
        assert got[domain] == pytest.approx(area, abs=1e-12)


def test_unparseable_is_a_miss(spark):
    r = evaluate.binary_metrics(scored(spark, [(FRAUD, True), ("garbage", True)]), ["domain"]).first()
    assert (r.json_validity, r.recall, r.precision) == (0.5, 0.5, 1.0)


def test_no_positives(spark):
    r = evaluate.binary_metrics(scored(spark, [(LEGIT, False)]), ["domain"]).first()
    assert (r.precision, r.recall, r.f1, r.pr_auc) == (0, 0, 0, 0)


def test_misalignment_fails_the_job(spark):
    gold = spark.createDataFrame([(0, True), (1, False)], "row_idx long, gold boolean")
    for ids in ([0], [0, 1, 2], [0, 2]):
        raw = spark.createDataFrame([(i, FRAUD) for i in ids], "row_idx long, raw string")
        with pytest.raises(Exception, match="do not match one to one"):
            evaluate.align(raw, gold).count()
    raw = spark.createDataFrame([(1, LEGIT), (0, FRAUD)], "row_idx long, raw string")
    assert evaluate.align(raw, gold).count() == 2


def test_gate(spark):
    m = evaluate.binary_metrics(scored(spark, [(FRAUD, True), (LEGIT, False)]), ["domain"])
    assert evaluate.regression_gate(m).first().gate_failed is False
    assert evaluate.regression_gate(m, RegressionFloors(min_f1=1.01)).first().gate_failed is True
    assert evaluate.regression_gate(m.withColumn("f1", F.lit(float("nan")))).first().gate_failed is True
    assert evaluate.regression_gate(m.withColumn("f1", F.lit(None).cast("double"))).first().gate_failed is True


def test_flattened_report(spark, tmp_path, folder):
    (tmp_path / "m.json").write_text(
        '{"in_distribution": {"baseline": {"f1": 0.9, "n": 10}, "llm": null},\n'
        ' "crossdomain": {"data": "x", "baseline": {"f1": 0.5}, "llm": {"pr_auc": 0.7}}}'
    )
    doc = read_document(spark, f"{folder}/m.json", METRICS_REPORT)
    got = {r.name: r.value for r in evaluate.flatten_report(doc).collect()}
    assert got == {"id_baseline_f1": 0.9, "id_baseline_n": 10.0, "crossdomain_baseline_f1": 0.5, "crossdomain_llm_pr_auc": 0.7}


def analysed(spark):
    df = scored(spark, [(FRAUD, True), (FRAUD, False), (LEGIT, False), ("not json", True), ('{"risk":"high"}', True)])
    base = spark.createDataFrame([(0, False), (1, False), (2, False), (3, True), (4, True)], "row_idx long, base boolean")
    return errors.error_rows(evaluate.align(df, base), "base")


def test_error_analysis(spark):
    rows = analysed(spark)
    s = errors.error_summary(rows, ["domain"]).first()
    assert (s.tn, s.fp, s.fn, s.tp) == (1, 1, 2, 1)
    assert (s.invalid_total, s.invalid_gold_fraud, s.fn_valid_output, s.fn_invalid_output) == (2, 2, 0, 2)
    assert (s.hint_high, s.fallback_tp, s.fallback_fn, s.baseline_wrong_llm_correct) == (1, 2, 1, 1)
    cats = {r["index"]: r.categories for r in errors.error_records(rows).collect()}
    assert cats[0] == ["true_positive", "baseline_wrong_llm_correct"]
    assert cats[3] == ["false_negative", "invalid_json"]
    assert {r.category: r.n for r in errors.case_counts(rows, ["domain"]).collect()} == {
        "true_positive": 1, "false_positive": 1, "true_negative": 1, "false_negative": 2, "invalid_json": 2,
        "baseline_wrong_llm_correct": 1,
    }
    reasons = errors.invalid_by_reason(errors.error_summary(rows, ["domain"]), ["domain"]).collect()
    assert {r.reason: r.n for r in reasons} == {"missing_json_object": 1, "missing_required_field": 1}


def test_dominant_output_takes_the_first_of_equals(spark):
    other = FRAUD.replace("x", "y")
    rows = errors.error_rows(scored(spark, [(other, False), (FRAUD, False), (other, False), (FRAUD, False), (LEGIT, False)]))
    d = errors.dominant_false_positive(rows, ["domain"]).first()
    assert (d.output, d["count"], d.share_of_false_positives) == (other, 2, 0.5)


def test_review_sample_is_bounded_and_stable(spark):
    rows = errors.error_rows(scored(spark, [(FRAUD, False)] * 50 + [("x", True)] * 3))
    a = errors.review_sample(rows, 20, 42)
    count = {r["category"]: r["count"] for r in a.groupBy("category").count().collect()}
    assert count == {"false_positive": 20, "false_negative": 3, "invalid_json": 3}
    assert a.exceptAll(errors.review_sample(rows.repartition(5), 20, 42)).count() == 0
    texts = rows.select("row_idx", F.lit("t | t").alias("transcript"), "raw")
    assert errors.review_excerpts(a, texts).first().transcript_excerpt == "t \\| t"
