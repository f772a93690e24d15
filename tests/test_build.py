import json

import pytest
from pyspark.sql import functions as F

from callsieve.operators import evaluate, features
from callsieve.plans.build import build_dataset, materialize_features
from callsieve.plans.evaluation import analyse, decide, evaluate_models, score_domain
from callsieve.schemas import MANIFEST_DOC, RAI_CASE, QualityPolicy
from callsieve.session import fresh_dir, path_exists, scratch
from callsieve.sources import corpora, sinks
from callsieve.sources.files import (
    indexed_lines,
    load_predictions,
    load_split,
    read_document,
    read_features,
    read_json_lines,
    read_prompts,
)


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return f"file://{path}"


def landed(tmp_path):
    """The four call sources; dialogue 3 is shared by two of them."""
    one = [{"dialogue": f"plain call {i}", "label": i % 2} for i in range(40)]
    two = [{"dialogue": f"Agent: call {i}\nCustomer: ok", "label": i % 2, "type": "ssn" if i % 2 else "delivery"} for i in range(40)]
    three = [{"dialogue": f"plain  call {i}", "labels": 1, "type": "refund"} for i in range(5)]
    four = [{"dialogue": f"last {i} www.x", "labels": i % 2, "type": "reward"} for i in range(20)]
    return [lines(tmp_path / f"s{i}.jsonl", rows) for i, rows in enumerate((one, two, three, four))]


def test_from_landed_files_to_promotion(spark, tmp_path, folder):
    pairs = corpora.load_corpus(spark, "calls", landed(tmp_path), read_json_lines)
    assert pairs.count() == 100                      # five re-spaced copies are gone
    out, store = f"{folder}/build", f"{folder}/store"
    first = build_dataset(spark, pairs, out, "calls", generated_at="2026-01-01")
    sizes = {r.split: r.n for r in first.collect()}
    assert sizes == {"train": 74, "val": 11, "test": 15}
    version = {r.checksum for r in first.collect()}
    again = build_dataset(spark, pairs, out, "calls", generated_at="2027-01-01")
    assert {r.checksum for r in again.collect()} == version

    report = materialize_features(spark, out, store).first()
    materialize_features(spark, out, store)
    assert (report.materialized_rows, report.stored_rows) == (100, 100)
    stored = read_features(spark, store)
    assert features.feature_totals(stored).first().fraud_rows == 50
    assert stored.filter("has_url = 1").count() == 20

    # Gold as predictions: every metric is 1.
    test = f"{out}/examples/split=test"
    gold = load_split(spark, test)
    assert gold.count() == 15 and read_prompts(spark, test).count() == 15
    sinks.write_predictions(gold.select("row_idx", F.col("completion").alias("raw")).repartition(3), f"{folder}/pred.jsonl")
    scored = score_domain(spark, test, f"{folder}/pred.jsonl", "id")
    m = evaluate_models(scored).first()
    assert (m.f1, m.pr_auc, m.json_validity, m.n, m.gate_failed) == (1.0, 1.0, 1.0, 15, False)
    base = scored.select("domain", "row_idx", (~F.col("gold")).alias("pred"))
    rows = analyse(scored, base)
    assert rows.filter(F.array_contains("categories", "baseline_wrong_llm_correct")).count() == 15
    sinks.write_error_rows(rows.select("row_idx", "categories"), f"{folder}/rows")
    long = evaluate.metrics_long(evaluate.binary_metrics(scored, ["domain"]), ["domain"])
    sinks.write_metrics(long, f"{folder}/metrics")
    assert spark.read.parquet(f"{folder}/metrics").filter("name = 'id_f1'").first().value == 1.0

    case = ("c", "prompt_injection", None, "t", True, '{"risk":"high","fraud_type":"other","reason":"r"}')
    cases = spark.createDataFrame([case], RAI_CASE).withColumn("candidate", F.lit("v1"))
    c = spark.createDataFrame([("v1",), ("v2",)], "candidate string")
    ops = spark.createDataFrame([("v1", 100.0, 0.0)], "candidate string, p95_latency_ms double, error_rate double")
    metrics = evaluate.binary_metrics(scored, ["domain"]).withColumn("candidate", F.lit("v1"))
    assert {r.candidate: r.decision for r in decide(c, metrics, ops, cases).collect()} == {"v1": "promote", "v2": "reject"}


def test_gate_stops_after_the_diagnostics(spark, folder):
    pairs = spark.createDataFrame([(0, 0, "", None), (0, 1, "fine", ("low", "none", "r", []))],
                                  "source_rank int, row_idx long, transcript string, verdict struct<risk: string, fraud_type: string, reason: string, flagged_spans: array<string>>")
    with pytest.raises(ValueError, match="0.5000 exceeds 0.0100"):
        build_dataset(spark, pairs, f"{folder}/b", "calls")
    assert spark.read.json(f"{folder}/b/quarantine").count() == 1
    assert spark.read.json(f"{folder}/b/quality_report").first()["passed"] is False
    done = build_dataset(spark, pairs, f"{folder}/c", "email", QualityPolicy(max_contract_violation_ratio=1.0), eval_only=True)
    assert [(r.split, r.n, r.fraud_ratio) for r in done.collect()] == [("test", 1, 0.0)]


def test_other_corpora(spark, tmp_path):
    mail = lines(tmp_path / "m.jsonl", [{"text": "a", "label": " fraud"}, {"text": "a", "label": "NOT_FRAUD"}])
    got = corpora.load_corpus(spark, "email", [mail], read_json_lines).orderBy("row_idx").collect()
    assert [r.verdict.risk for r in got] == ["high", "low"]
    parts = [lines(tmp_path / f"d{i}.jsonl", [{"text": "t", "label": i % 2}]) for i in range(3)]
    got = corpora.load_corpus(spark, "domains", parts, read_json_lines).orderBy("source_rank").collect()
    assert got[1].verdict.reason == "Cross-domain job scams text labeled deceptive."
    with pytest.raises(ValueError):
        corpora.load_corpus(spark, "calls", parts, read_json_lines)


def test_missing_text_reaches_the_gate(spark):
    spec = corpora.SourceSpec("s")
    df = spark.createDataFrame([(0, None, 1), (1, None, 0), (2, "None", 0)], "row_idx long, dialogue string, label int")
    assert corpora.first_of_each_text(corpora.unify([(spec, df)])).count() == 3


def test_prediction_files(spark, tmp_path, folder):
    (tmp_path / "p.jsonl").write_text('{"output":"c","completion":"b"}\n\n{"prediction":null,"output":"x"}\n  \n{"output":"z"}\n')
    got = [r.raw for r in load_predictions(spark, f"{folder}/p.jsonl").orderBy("row_idx").collect()]
    assert got == ["b", None, "z"]
    (tmp_path / "p.txt").write_text("one\n\n two \n")
    got = load_predictions(spark, f"{folder}/p.txt").orderBy("row_idx").collect()
    assert [(r.row_idx, r.raw) for r in got] == [(0, "one"), (1, " two ")]
    (tmp_path / "bad.jsonl").write_text('{"text":"c"}\n')
    with pytest.raises(Exception, match="no prediction/completion/output key"):
        load_predictions(spark, f"{folder}/bad.jsonl").collect()


def test_unclean_gold_fails_the_job(spark, tmp_path):
    path = lines(tmp_path / "g.jsonl", [{"prompt": "p", "completion": "not json"}])
    with pytest.raises(Exception, match="gold completion failed schema parse"):
        load_split(spark, path).collect()


def test_line_numbers_hold_across_blocks(spark, tmp_path, folder):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = indexed_lines(spark, f"{folder}/long.txt")
        assert df.count() == 20000
        assert df.filter(F.col("value") != F.concat(F.lit("line "), F.col("row_idx").cast("string"))).count() == 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(file" not in plan  # the lines stay where they are
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_all_there_under_other_splits(spark, tmp_path, folder):
    """Splits in force when a reader is called and when its rows are used may differ."""
    (tmp_path / "p.txt").write_text("".join(f"line {i}\n" for i in range(20000)))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for then, later in (("16384", "4096"), ("4096", "100000"), (usual, "1000")):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", then)
            df = load_predictions(spark, f"{folder}/p.txt")
            spark.conf.set("spark.sql.files.maxPartitionBytes", later)
            assert df.count() == 20000
            assert df.filter(F.col("raw") != F.concat(F.lit("line "), F.col("row_idx").cast("string"))).count() == 0
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_scratch_folders_go(spark):
    with scratch(spark):
        first = fresh_dir(spark, "one")
        spark.range(3).write.parquet(first)
        with scratch(spark):
            inner = fresh_dir(spark, "two")
            spark.range(3).write.parquet(inner)
        assert path_exists(spark, first) and not path_exists(spark, inner)
    kept = fresh_dir(spark, "three")
    spark.range(3).write.parquet(kept)
    assert not path_exists(spark, first) and path_exists(spark, kept)


def test_manifest_document(spark, tmp_path, folder):
    (tmp_path / "manifest.json").write_text(json.dumps(
        {"dataset": "d", "config_snapshot": {"test_size": 0.15}, "splits": {"test": {"n": 2, "fraud_ratio": 0.5}}}, indent=2))
    r = read_document(spark, f"{folder}/manifest.json", MANIFEST_DOC).first()
    assert (r.dataset, r.splits["test"].n, r.config_snapshot.test_size) == ("d", 2, 0.15)


def test_positions_are_unique_over_the_files_of_a_folder(spark, tmp_path):
    for name, texts in (("b", ["z", "y"]), ("a", ["x", "", "y"])):
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / f"{name}.jsonl").write_text("".join(json.dumps({"dialogue": t, "label": 1}) + "\n" if t else "\n" for t in texts))
    rest = [lines(tmp_path / f"r{i}.jsonl", [{"dialogue": f"only {i}", "label": 0, "labels": 0, "type": "t"}]) for i in range(3)]
    got = corpora.load_corpus(spark, "calls", [f"file://{tmp_path}/one", *rest], read_json_lines).filter("source_rank = 0").orderBy("row_idx").collect()
    assert [(r.row_idx, r.transcript) for r in got] == [(0, "x"), (1, "y"), (2, "z")]


def test_repeated_positions_and_keys_are_refused(spark):
    df = spark.createDataFrame([(0, "a", 1), (0, "b", 0)], "row_idx long, dialogue string, label int")
    with pytest.raises(ValueError, match="2 rows at position 0"):
        corpora.first_of_each_text(corpora.unify([(corpora.SourceSpec("s"), df)]))
    with pytest.raises(Exception, match="no place in the order"):
        corpora.first_of_each_text(corpora.unify([(corpora.SourceSpec("s"), df.limit(1).withColumn("row_idx", F.lit(-1)))])).collect()
    twice = spark.createDataFrame([(0, "p"), (0, "p"), (1, "p")], "row_idx long, raw string")
    gold = spark.createDataFrame([(0, True), (1, True)], "row_idx long, gold boolean")
    with pytest.raises(Exception, match="predictions repeat a key"):
        evaluate.align(twice, gold).collect()


def test_broken_documents_fail_the_job(spark, tmp_path, folder):
    (tmp_path / "c.jsonl").write_text('{"case_id": "one"}\n{"case_id": \n')
    (tmp_path / "m.json").write_text('{"dataset": "d"')
    from callsieve.sources.files import load_cases

    for read in (lambda: load_cases(spark, f"{folder}/c.jsonl"), lambda: read_document(spark, f"{folder}/m.json", MANIFEST_DOC)):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
            read().collect()


def test_shared_folder_or_stop():
    from callsieve.session import shared_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="shared folder"):
        shared_dir(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///work/"
    assert shared_dir(Session) == "hdfs:///work"
