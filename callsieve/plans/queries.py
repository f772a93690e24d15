"""Registered queries: every operator over the whole shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.functions import contract, text, verdict
from callsieve.operators import (
    boosting,
    control,
    drift,
    errors,
    evaluate,
    features,
    quality,
    release,
    split,
    telemetry,
)
from callsieve.operators.dedup import keep_first, keep_new
from callsieve.plans import inputs as I
from callsieve.schemas import DriftPolicy, RegressionFloors
from callsieve.session import configure, fresh_dir, publish_file
from callsieve.sources import corpora, sinks
from callsieve.sources.digests import file_block_digests, folded_digests
from callsieve.sources.tail import append_lines
from callsieve.sources.files import (
    load_cases,
    load_predictions,
    load_split,
    read_document,
    read_features,
    read_json_lines,
    stream_table,
)
from callsieve.streaming import ingest, monitor

Query = Callable[[SparkSession, str], DataFrame]


def _r(c: Column | str, digits: int = 9) -> Column:
    """Doubles are compared to nine digits: sums have no fixed order."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- text, contract, quality ------------------------------------------------

def language_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Contract, first-wins de-duplication and features by language.

    All text work is in one projection; only scalars are shuffled.
    """
    slim = quality.classify(I.transcripts(spark, sf)).select(
        "ordinal", "fingerprint", "contract_error", "lang",
        *[v.alias(k) for k, v in text.text_features(F.col("transcript")).items()],
    )
    return quality.accept(slim).groupBy("lang").agg(
        F.count(F.lit(1)).alias("transcripts"),
        _r(F.avg("char_count")).alias("avg_chars"),
        _r(F.avg("word_count")).alias("avg_words"),
        _r(F.avg("turn_count")).alias("avg_turns"),
        _r(F.avg("digit_ratio")).alias("avg_digit_ratio"),
        F.sum("has_url").alias("with_url"),
    )


def transcript_features(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    f = text.text_features(t)
    return I.documents(spark, sf).select(
        "doc_id",
        text.fingerprint(t).alias("entity_id"),
        f["char_count"].alias("char_count"),
        f["word_count"].alias("word_count"),
        f["turn_count"].alias("turn_count"),
        _r(f["digit_ratio"], 12).alias("digit_ratio"),
        f["has_url"].alias("has_url"),
    )


def text_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return I.documents(spark, sf).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def contract_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quarantine(I.pairs(spark, sf))


def accepted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.accepted(I.pairs(spark, sf)).select(
        "row_idx", "fingerprint", F.col("verdict.risk").alias("risk")
    )


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.transform(
        F.map_entries("rejection_reasons"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return quality.quality_report(I.pairs(spark, sf)).select(
        "input_rows", "accepted_rows", "rejected_rows", "duplicate_rows", "contract_violations",
        _r("contract_violation_ratio").alias("contract_violation_ratio"),
        F.array_join(entries, ";").alias("rejection_reasons"),
        "passed",
    )


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = I.documents(spark, sf).select(
        F.col("doc_id"), F.col("doc_id").alias("ordinal"),
        text.fingerprint(F.col("text")).alias("fingerprint"), "lang",
    )
    return keep_first(keyed, "fingerprint").select("doc_id", "fingerprint", "lang")


def incremental_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Two drops of documents, even and odd ids; the second is de-duplicated against the first."""
    root = fresh_dir(spark, "fingerprints")
    keyed = I.documents(spark, sf).select(
        "doc_id", F.col("doc_id").alias("ordinal"), (F.col("doc_id") % 2).cast("int").alias("drop"), text.fingerprint(F.col("text")).alias("fingerprint")
    )
    kept = []
    for drop in (0, 1):
        batch = keyed.filter(F.col("drop") == drop)
        new = keep_new(batch, "fingerprint", spark.read.parquet(root)) if drop else keep_first(batch, "fingerprint")
        new.select("fingerprint", "doc_id", "drop").write.mode("append").partitionBy("drop").parquet(root)
    return spark.read.parquet(root).select("doc_id", "fingerprint", "drop")


def intake_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized texts and recordings, refused with a reason; by source."""
    d = I.documents(spark, sf).select(
        "source",
        contract.text_intake(F.col("text")).alias("text_reason"),
        contract.audio_intake(F.octet_length("text").cast("long") * 4096).alias("audio_reason"),
    )
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("text_reason").alias("texts_refused"),
        F.count("audio_reason").alias("recordings_refused"),
    )


# --- written and read back ------------------------------------------------------

def quarantine_written(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "quarantine")
    sinks.write_quarantine(quality.quarantine(I.pairs(spark, sf)), path)
    return spark.read.schema("fingerprint string, reason string, transcript_chars int").json(path)


def report_written(spark: SparkSession, sf: str) -> DataFrame:
    """The report as a document, and whether the stop gate would let the build go on."""
    path = fresh_dir(spark, "report")
    report = quality.quality_report(I.pairs(spark, sf))
    sinks.write_report(report, path)
    back = read_document(spark, path, report.schema)
    try:
        quality.enforce_quality(back)
        stopped = ""
    except quality.QualityGateError as error:
        stopped = str(error)
    return back.select(
        "input_rows", "accepted_rows", _r("contract_violation_ratio").alias("contract_violation_ratio"), "passed", F.lit(stopped).alias("stopped")
    )


def errors_written(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "errors")
    records = errors.error_records(_error_rows(spark, sf), ["domain"])
    sinks.write_error_rows(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.withColumn("categories", F.array_join("categories", ","))


def metrics_written(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "metrics")
    long = evaluate.metrics_long(_metrics(spark, sf), ["domain", "model"])
    sinks.write_metrics(long, path)
    return spark.read.schema(long.schema).parquet(path).select("name", _r("value").alias("value"))


def examples_written(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted pairs as instruction examples of an evaluation-only dataset, read back as gold, blank lines added."""
    path = fresh_dir(spark, "examples")
    pairs = quality.accepted(I.pairs(spark, sf)).select(F.col("row_idx").alias("row_key"), "row_idx", "transcript", "verdict")
    sinks.write_examples(sinks.to_examples(split.assign_splits(pairs, eval_only=True)), path)
    spark.range(3).select(F.lit("   ").alias("value")).write.mode("append").text(f"{path}/split=test")
    gold = load_split(spark, f"{path}/split=test")
    return gold.select("row_idx", F.sha2("transcript", 256).alias("transcript_sha"), F.col("verdict.risk").alias("risk"), "gold")


def cases_written(spark: SparkSession, sf: str) -> DataFrame:
    """Responsible-AI cases as a file, one candidate after the other."""
    path = fresh_dir(spark, "cases")
    I.rai_cases(spark, sf).write.partitionBy("candidate").json(path)
    checks = release.rai_checks(release.rai_metrics(load_cases(spark, path), ["candidate"]))
    return checks.select("candidate", "n", "counterfactual_pairs", "passed", F.array_join("failed_checks", ",").alias("failed_checks"))


def split_file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the files of written splits, folded from blocks of 4 KB."""
    path = fresh_dir(spark, "split-files")
    rows = _split_docs(spark, sf).select("split", F.col("row_key").cast("string").alias("value"), "row_key")
    rows.repartition("split").sortWithinPartitions("split", "row_key").select("split", "value").write.partitionBy("split").text(path)
    files = folded_digests(file_block_digests(spark, path, 4096))
    return files.select(F.regexp_extract("path", "split=([a-z]+)", 1).alias("split"), "length", "sha256")


# --- corpora and splits -----------------------------------------------------

def _sources(spark: SparkSession, sf: str):
    S = corpora.SourceSpec
    d = I.documents(spark, sf).join(I.labels(spark, sf), "doc_id", "left")
    call = d.select(
        F.col("doc_id").alias("row_idx"), F.col("text").alias("dialogue"),
        F.coalesce("toxic", F.lit(0)).alias("label"), F.col("source").alias("type"),
    )
    turns = I.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1048576 + F.col("turn")).alias("row_idx"),
        F.col("text").alias("dialogue"),
        (F.col("turn") % 2).cast("int").alias("labels"),
        F.col("role").alias("type"),
    )
    pages = I.table(spark, sf, "pages").select(
        F.col("page_id").alias("row_idx"), F.col("html").alias("text"),
        F.when(F.col("page_id") % 3 == 0, " fraud ").otherwise("NOT_FRAUD").alias("label"),
    )
    items = I.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_idx"), "text", (F.col("item_id") % 2).cast("int").alias("label")
    )
    return [
        (S("documents", type="type"), call),
        (S("conversations", label="labels", type="type"), turns),
        (S("pages", text="text", family="email"), pages),
        (S("benchmark", text="text", family="domain", domain="job_scams"), items),
    ]


def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    """Four differently shaped sources, unified and de-duplicated by text."""
    kept = corpora.first_of_each_text(corpora.unify(_sources(spark, sf)))
    return kept.select(
        "source_rank", "row_idx", text.fingerprint(F.col("transcript")).alias("fingerprint"),
        F.col("verdict.risk").alias("risk"), F.col("verdict.fraud_type").alias("fraud_type"),
        F.col("verdict.reason").alias("reason"),
    )


def corpus_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same from landed JSON Lines, several files for each source."""
    root = fresh_dir(spark, "landed")
    read = []
    for rank, (spec, frame) in enumerate(_sources(spark, sf)):
        frame.repartition("row_idx").write.json(f"{root}/{rank}")  # as many files as the input needs
        read.append((spec, read_json_lines(spark, f"{root}/{rank}", spec.schema)))
    kept = corpora.first_of_each_text(corpora.unify(read))
    return kept.select(
        "source_rank", "row_idx", text.fingerprint(F.col("transcript")).alias("fingerprint"),
        F.col("verdict.risk").alias("risk"), F.col("verdict.fraud_type").alias("fraud_type"),
        F.col("verdict.reason").alias("reason"),
    )


def predictions_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw outputs written as records, read back and aligned with gold rows."""
    raw = I.transcripts(spark, sf).select("row_idx", F.col("transcript").alias("raw"))
    path = fresh_dir(spark, "predictions")
    sinks.write_predictions(raw, path)
    gold = I.transcripts(spark, sf).select("row_idx", "lang")
    back = evaluate.align(load_predictions(spark, path, json_records=True), gold)
    return back.select("row_idx", "lang", F.sha2("raw", 256).alias("raw_sha"))


def predictions_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs matched to rows by the order of lines alone, read with other file splits than were in force when it was asked for."""
    path = fresh_dir(spark, "ordered") + ".jsonl"
    rows = I.documents(spark, sf).select("doc_id", F.to_json(F.struct(F.col("text").alias("prediction"))).alias("value"))
    # Range parts in order of their names; their number follows the input, not a fixed three tasks.
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        back = load_predictions(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    return back.select("row_idx", F.sha2("raw", 256).alias("raw_sha"))


def call_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    v = verdict.call_verdict(F.col("is_scam"), F.col("call_type"))
    rows = I.typed_calls(spark, sf).select("call_type", "is_scam", v.alias("v"))
    return rows.groupBy(
        "call_type", "is_scam", F.col("v.risk").alias("risk"),
        F.col("v.fraud_type").alias("fraud_type"), F.col("v.reason").alias("reason"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _split_docs(spark: SparkSession, sf: str) -> DataFrame:
    slim = I.labels(spark, sf).select(
        F.col("doc_id").alias("row_key"), (F.col("toxic") == 1).alias("is_fraud")
    )
    return split.stratified_split(slim)


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split_docs(spark, sf).select(F.col("row_key").alias("doc_id"), "is_fraud", "split")


def split_manifest(spark: SparkSession, sf: str) -> DataFrame:
    manifest = split.split_manifest(
        _split_docs(spark, sf), "labels", checksum_columns=("row_key", "is_fraud")
    )
    return manifest.select("dataset", "split", "n", _r("fraud_ratio").alias("fraud_ratio"))


def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    v = I.pairs(spark, sf).select(F.col("row_idx").alias("row_key"), "verdict")
    return split.label_distribution(split.stratified_split(split.with_label(v)))


def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that would leak between splits if copies were not removed."""
    d = I.documents(spark, sf).select(
        F.col("doc_id").alias("row_key"), text.fingerprint(F.col("text")).alias("fingerprint"),
        (F.col("lang") == "en").alias("is_fraud"),
    )
    return split.split_overlap(split.stratified_split(d))


# --- features ----------------------------------------------------------------

def _feature_rows(spark: SparkSession, sf: str, labelled: bool) -> DataFrame:
    d = I.documents(spark, sf)
    if labelled:
        d = d.join(I.labels(spark, sf), "doc_id").withColumn("is_fraud", F.col("toxic") == 1)
    else:
        d = d.withColumn("is_fraud", F.lit(False))
    kind = F.col("lang")
    rows = d.select(
        F.col("doc_id").alias("row_idx"), F.col("text").alias("transcript"), "is_fraud",
        F.when(kind == "de", "test").when(kind == "fr", "val").otherwise("train").alias("split"),
    )
    return features.extract_features(rows, "v1", "documents")


def feature_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled features replace the unlabelled ones of the same key."""
    stored = features.latest_features(_feature_rows(spark, sf, labelled=False))
    table = features.upsert_features(stored, _feature_rows(spark, sf, labelled=True))
    return table.select(
        "entity_id", "dataset_version", "split", "char_count", "word_count", "turn_count",
        _r("digit_ratio", 12).alias("digit_ratio"), "has_url", "is_fraud",
    )


def feature_store(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the stored table: all rows, then a batch of labelled ones."""
    path = fresh_dir(spark, "feature-store")
    for labelled in (False, True):
        rows = features.latest_features(_feature_rows(spark, sf, labelled=labelled))
        sinks.write_features(rows.withColumn("is_fraud", F.coalesce("is_fraud", F.lit(0))), path)
    return read_features(spark, path).select(
        "entity_id", "dataset_version", "split", "char_count", "word_count", "turn_count",
        _r("digit_ratio", 12).alias("digit_ratio"), "has_url", "is_fraud",
    )


def feature_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows of one split from a store of two versions."""
    path = fresh_dir(spark, "feature-store")
    rows = features.latest_features(_feature_rows(spark, sf, labelled=True))
    for version in ("v1", "v2"):
        one = rows.filter((F.col("is_fraud") == 1) | (F.lit(version) == "v1")).withColumn("dataset_version", F.lit(version))
        sinks.write_features(one, path)
    found = [features.feature_lookup(read_features(spark, path), *q) for q in (("v1", "test", True), ("v2", "train", None), ("v2", "val", False))]
    return found[0].union(found[1]).union(found[2]).select("entity_id", "dataset_version", "split", "word_count", "is_fraud")


def materialize_report(spark: SparkSession, sf: str) -> DataFrame:
    return features.materialize_report(_feature_rows(spark, sf, labelled=False))


def feature_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.latest_features(_feature_rows(spark, sf, labelled=True))
    return features.feature_totals(rows)


# --- rendering and parsing ---------------------------------------------------

def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    v = verdict.call_verdict(F.col("turn") % 2 == 1, F.col("role"))
    prompt = verdict.render_prompt(F.col("text"))
    done = verdict.render_completion(v)
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2(prompt, 256).alias("prompt_sha"), done.alias("completion"),
        F.sha2(verdict.training_text(prompt, done, "</s>"), 256).alias("training_sha"),
        F.sha2(verdict.add_primer(prompt), 256).alias("primed_sha"),
    )


def prompt_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip, also where the text holds a close marker or has no open one."""
    odd = F.concat(F.col("text"), F.lit("\n\nVerdict: nested"))
    k = F.col("turn") % 4
    prompt = (
        F.when(k == 1, verdict.render_prompt(odd))
        .when(k == 2, F.col("text"))
        .when(k == 3, F.concat(F.lit("Transcript:\n"), F.col("text")))
        .otherwise(verdict.render_prompt(F.col("text")))
    )
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2(text.extract_transcript(prompt), 256).alias("transcript_sha")
    )


def prediction_parse(spark: SparkSession, sf: str) -> DataFrame:
    scored = evaluate.score_outputs(I.predictions(I.gold(spark, sf)))
    v = F.col("verdict")
    return scored.select(
        "row_idx", "failure", v["risk"].alias("risk"), v["fraud_type"].alias("fraud_type"),
        v["reason"].alias("reason"), F.size(v["flagged_spans"]).alias("spans"),
        "risk_hint", "pred", "score",
    )


# --- evaluation --------------------------------------------------------------

def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions aligned with gold by row and scored."""
    rows = I.gold(spark, sf).select("row_idx", "gold", "quality", "domain")
    raw = I.labels(spark, sf).select(
        F.col("doc_id").alias("row_idx"),
        I.raw_output(F.col("doc_id"), F.col("toxic") == 1).alias("raw"),
    )
    return evaluate.score_outputs(evaluate.align(raw, rows))


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    return I.predictions(I.gold(spark, sf)).select(
        "row_idx", "domain", "gold", F.col("base_pred").alias("pred"),
        F.col("base_score").alias("score"),
    )


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    llm = evaluate.binary_metrics(_scored(spark, sf), ["domain"])
    base = evaluate.binary_metrics(_baseline(spark, sf), ["domain"])
    return llm.withColumn("model", F.lit("llm")).unionByName(
        base.withColumn("model", F.lit("baseline"))
    )


def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    gated = evaluate.regression_gate(_metrics(spark, sf), RegressionFloors(0.7, 0.6, 0.7))
    return gated.select(
        "domain", "model", "n", "tp", "fp", "fn", "tn",
        *[_r(c).alias(c) for c in ("precision", "recall", "f1", "pr_auc", "json_validity")],
        "gate_failed",
    )


def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    long = evaluate.metrics_long(_metrics(spark, sf), ["domain", "model"])
    return long.select("name", _r("value").alias("value"))


def champion(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are the sources, in the order of their number."""
    rows = I.predictions(I.gold(spark, sf))
    scored = evaluate.score_outputs(rows)
    by_source = evaluate.binary_metrics(scored, ["source"])
    runs = by_source.select(
        F.lit("control").alias("model_name"),
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("version"),
        _r("f1").alias("f1"),
    )
    return release.champion(runs).select("model_name", "champion_version", "champion_f1")


# --- error analysis ------------------------------------------------------------

def _error_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = _baseline(spark, sf).select("row_idx", F.col("pred").alias("base"))
    return errors.error_rows(evaluate.align(_scored(spark, sf), base), "base")


def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    records = errors.error_records(_error_rows(spark, sf), ["domain"])
    return records.withColumn("categories", F.array_join("categories", ","))


def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = errors.error_summary(_error_rows(spark, sf), ["domain"])
    doubles = [c for c, t in s.dtypes if t == "double"]
    return s.select(*[_r(c).alias(c) if c in doubles else F.col(c) for c in s.columns])


def error_case_counts(spark: SparkSession, sf: str) -> DataFrame:
    return errors.case_counts(_error_rows(spark, sf), ["domain"])


def invalid_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return errors.invalid_by_reason(
        errors.error_summary(_error_rows(spark, sf), ["domain"]), ["domain"]
    )


def dominant_false_positive(spark: SparkSession, sf: str) -> DataFrame:
    d = errors.dominant_false_positive(_error_rows(spark, sf), ["domain"])
    return d.withColumn("share_of_false_positives", _r("share_of_false_positives"))


def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    return errors.review_sample(_error_rows(spark, sf), 20, 42).select(
        "category", "row_idx", "gold", "pred", "json_valid", "failure"
    )


def domain_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = _error_rows(spark, sf)
    rates = errors.derived_rates(
        errors.error_summary(rows, ["domain"]),
        errors.dominant_false_positive(rows, ["domain"]),
        ["domain"],
    )
    names = [c for c in rates.columns if c != "domain"]
    return rates.unpivot("domain", names, "metric", "value").select("metric", "domain", _r("value").alias("value"))


# --- release -------------------------------------------------------------------

def _rai(spark: SparkSession, sf: str) -> DataFrame:
    return release.rai_checks(release.rai_metrics(I.rai_cases(spark, sf), ["candidate"]))


def rai_checks(spark: SparkSession, sf: str) -> DataFrame:
    names = (
        "schema_validity", "prompt_injection_recall", "counterfactual_consistency",
        "benign_false_positive_rate", "unsupported_span_rate",
    )
    return _rai(spark, sf).select(
        "candidate", *[_r(c).alias(c) for c in names], "n", "counterfactual_pairs", "passed",
        F.array_join("failed_checks", ",").alias("failed_checks"),
    )


def _operational(spark: SparkSession, sf: str) -> DataFrame:
    d = I.documents(spark, sf).select("doc_id", F.col("lang").alias("candidate"))
    return release.operational_metrics(I.requests(spark, sf).join(d, F.col("request_id") == F.col("doc_id")))


def operational_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Latency percentile and error rate of the requests that served each language."""
    return _operational(spark, sf).select("candidate", _r("p95_latency_ms").alias("p95_latency_ms"), _r("error_rate").alias("error_rate"))


def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Languages are candidates, and so are roles, which have no evidence.

    Each request served the document of its number.
    """
    llm = evaluate.binary_metrics(_scored(spark, sf), ["domain"]).withColumnRenamed(
        "domain", "candidate"
    )
    d = I.documents(spark, sf)
    roles = I.table(spark, sf, "conversations").select(F.col("role").alias("candidate"))
    candidates = d.select(F.col("lang").alias("candidate")).unionByName(roles).distinct()
    evidence = release.promotion_evidence(candidates, llm, _operational(spark, sf), _rai(spark, sf))
    return release.promotion_decision(evidence).select(
        "candidate", "decision", "passed",
        F.array_join("failed_checks", ",").alias("failed_checks"),
    )


def retry_resolution(spark: SparkSession, sf: str) -> DataFrame:
    r = release.resolve_attempts(I.attempts(spark, sf))
    return r.select(
        "request_id", F.col("verdict.risk").alias("risk"), F.col("verdict.reason").alias("reason"),
        "used_fallback", "invalid_attempts",
    )


# --- drift and telemetry -------------------------------------------------------

def drift_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(drift.rolling_drift(I.served(spark, sf)))


def drift_rolling_short(spark: SparkSession, sf: str) -> DataFrame:
    """The same over ten predictions, so that blocks and their seams occur."""
    return _rolled(drift.rolling_drift(I.served(spark, sf), DriftPolicy(window=10)))


def _rolled(rolled: DataFrame) -> DataFrame:
    return rolled.select(
        "key", "event_id", "pos", "window_size", _r("fraud_rate").alias("fraud_rate"),
        _r("psi").alias("psi"), "alert",
    )


def drift_status(spark: SparkSession, sf: str) -> DataFrame:
    s = drift.drift_status(I.served(spark, sf))
    return s.select(
        "key", "window_size", _r("fraud_rate").alias("fraud_rate"), _r("psi").alias("psi"), "alert"
    )


def request_counts(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.request_counts(I.requests(spark, sf))


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.latency_histogram(I.requests(spark, sf)).select(
        "endpoint", F.col("le").cast("string").alias("le"), "requests"
    )


def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = telemetry.request_rate(I.requests(spark, sf), 60, 5)
    return r.select("status", "t", _r("rate").alias("rate"))


def invalid_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = telemetry.invalid_rate(I.requests(spark, sf), 300, 5)
    return r.select("t", _r("rate").alias("rate"))


def latency_p95(spark: SparkSession, sf: str) -> DataFrame:
    r = telemetry.latency_quantile(I.requests(spark, sf), 0.95, 300, 5)
    return r.select("endpoint", "t", _r("latency_seconds").alias("latency_seconds"))


def latency_table(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry.latency_table(I.requests(spark, sf))
    doubles = [c for c, k in t.dtypes if k == "double"]
    return t.select(*[_r(c, 6).alias(c) if c in doubles else F.col(c) for c in t.columns])


def live_rates(spark: SparkSession, sf: str) -> DataFrame:
    r = monitor.live_rates(I.requests(spark, sf), "1 minute")
    return r.select(
        F.unix_seconds("window_start").alias("window_start"), "key", "requests", "errors",
        "invalid", _r("fraud_rate").alias("fraud_rate"),
    )


# --- streaming -----------------------------------------------------------------

def event_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Contract and features of every record, as the stream computes them."""
    e = ingest.read_event(I.call_records(spark, sf))
    return e.select(
        "stream_partition", "source_offset", "error_code", "event_id",
        F.unix_seconds("occurred_at").alias("occurred_at"), "transcript_hash", "word_count",
        _r("digit_ratio", 12).alias("digit_ratio"),
    )


def _run_stream(spark: SparkSession, sf: str) -> ingest.StreamStore:
    """Ingest the documents as a stream into a fresh store."""
    configure(spark)
    d = stream_table(
        spark, sf, "documents", "doc_id long, text string, lang string, source string"
    )
    store = ingest.StreamStore(fresh_dir(spark, "stream"))
    ingest.run_ingestion(I.record_of_document(d), store)
    return store


def stream_curated(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.curated_events(spark, _run_stream(spark, sf)).select(
        "event_id", "stream_partition", "source_offset",
        F.unix_seconds("occurred_at").alias("occurred_at"), "source", "transcript_hash",
        "char_count", "word_count", "turn_count", _r("digit_ratio", 12).alias("digit_ratio"),
        "has_url",
    )


def stream_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.dead_letters(spark, _run_stream(spark, sf)).select(
        "stream_partition", "source_offset", "payload_hash", "error_code"
    )


def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.stream_statistics(spark, _run_stream(spark, sf))


def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """The same from drops with interleaved offsets, a file a batch, in two runs."""
    configure(spark)
    store = ingest.StreamStore(fresh_dir(spark, "stream"))
    block = F.floor(F.col("source_offset") / 50)  # an event and its repeat stay in one file
    drop = F.pmod(block, F.lit(4))
    records = I.call_records(spark, sf).withColumn("_drop", drop)
    for turn in ((3, 1), (2, 0)):
        for k in turn:
            records.filter(F.col("_drop") == k).drop("_drop").repartition(2, block).write.parquet(f"{store.drops}/{k}")
        ingest.run_ingestion(ingest.record_stream(spark, store.drops, 1), store)
    return ingest.stream_statistics(spark, store)


def stream_growing_file(spark: SparkSession, sf: str) -> DataFrame:
    """One append-only file of all records, handled after each of three appends."""
    configure(spark)
    store = ingest.StreamStore(fresh_dir(spark, "stream"))
    path = fresh_dir(spark, "growing") + ".jsonl"
    line = F.regexp_replace("payload", "[\r\n]", " ")
    records = I.call_records(spark, sf).select("stream_partition", "source_offset", line.alias("line"))
    records = records.withColumn("third", F.pmod(F.col("source_offset"), F.lit(3)))
    order = ["third", "source_offset", "stream_partition"]
    for k in range(3):
        added = records.filter(F.col("third") == k).select(*order, F.col("line").alias("value"))
        if append_lines(spark, added, order, path) is None:  # a store that tasks cannot write into by name
            grown = fresh_dir(spark, "grown")
            upto = records.filter(F.col("third") <= k).coalesce(1).sortWithinPartitions(*order)
            upto.select("line").write.text(grown)
            publish_file(spark, grown, path)
        ingest.process_jsonl(spark, path, store, "calls")
    return ingest.curated_events(spark, store).select(
        "event_id", "source_offset", F.unix_seconds("occurred_at").alias("occurred_at"), "transcript_hash", "char_count"
    )


def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Drift status after the event stream has been folded into the tails."""
    configure(spark)
    e = stream_table(
        spark, sf, "events", "event_id long, ts timestamp_ntz, event_type string, value double"
    ).select(
        F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        "event_id", (F.col("value") > 35).alias("is_fraud"),
    )
    root = fresh_dir(spark, "drift")
    monitor.start_drift_monitor(e, root).awaitTermination()
    return monitor.drift_gauges(spark, root).select(
        "key", "window_size", _r("fraud_rate").alias("fraud_rate"), _r("psi").alias("psi"), "alert"
    )


# --- control model ---------------------------------------------------------------

def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary of all documents with term and document counts and idf."""
    d = I.documents(spark, sf)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    vocab = control.vocabulary(control.term_counts(d), 2, 20_000)
    counted = vocab.select("term", "tf", "df", F.lit("all").alias("_one")).join(
        F.broadcast(n.withColumn("_one", F.lit("all"))), "_one"
    )
    return counted.select(
        "term", "tf", "df", _r(control.smooth_idf(F.col("n"), F.col("df"))).alias("idf")
    )


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse document vectors of all documents."""
    d = I.documents(spark, sf)
    return control.tfidf_weights(d, d, "doc_id").select("doc_id", "term", _r("weight").alias("weight"))


#: Size of the registered control: a fit at full size takes ``300 * 6`` passes.
CONTROL = {"trees": 10, "depth": 3, "bins": 16, "step": 0.3}


def control_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The boosted control, fitted on labelled documents of four fifths of the ids, over all documents."""
    d = I.documents(spark, sf)
    path = fresh_dir(spark, "weights")
    control.tfidf_weights(d, d, "doc_id").write.parquet(path)
    weights = spark.read.parquet(path)
    train = I.labels(spark, sf).filter("doc_id % 5 > 0").select("doc_id", (F.col("quality") == 0).alias("label"))
    model = boosting.fit_boosted(weights, train, "doc_id", **CONTROL)
    scored = boosting.score_boosted(model, weights, d.select("doc_id"), "doc_id")
    return scored.select("doc_id", _r("score").alias("score"), "pred")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        language_profile, transcript_features, text_excerpts, contract_quarantine,
        accepted_pairs, quality_report, first_wins_dedup, intake_gate, corpus_union,
        call_taxonomy, stratified_split, split_manifest, label_distribution, split_overlap,
        feature_upsert, materialize_report, feature_totals, prompt_render, prompt_extract,
        prediction_parse, model_metrics, metrics_long, champion, error_rows, error_summary,
        error_case_counts, invalid_reasons, dominant_false_positive, review_sample,
        domain_comparison, rai_checks, promotion_gate, retry_resolution, drift_rolling,
        drift_rolling_short, drift_status, request_counts, latency_histogram, request_rate, invalid_rate,
        latency_p95, latency_table, live_rates, event_contract, stream_curated,
        stream_dead_letter, stream_stats, stream_resume, stream_growing_file, stream_drift, tfidf_terms, corpus_from_files,
        predictions_roundtrip, feature_store, predictions_in_order, operational_metrics, tfidf_weights,
        control_scores, feature_lookups, incremental_dedup, quarantine_written, report_written, errors_written,
        metrics_written, examples_written, cases_written, split_file_digests,
    )
}
