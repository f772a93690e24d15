"""Frames of the engine's data model derived from the shared test tables.

Each is a plain projection or equi-join over whole tables, repeated in SQL by
the cross-check, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.functions.verdict import CALL_TYPE_MAP, make_verdict
from callsieve.schemas import FRAUD_TYPES
from callsieve.session import configure

SPAM_TYPES = FRAUD_TYPES[1:]
# Every word of the taxonomy, and some that hold none, one or two of them.
CALL_TYPES = (*CALL_TYPE_MAP, "bank refund", "first class", "", "delivery")
EPOCH_2026 = 1767225600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # The test tables of the smaller scales are one file of one row group: one task.
    return d.repartition(spark.sparkContext.defaultParallelism, "doc_id") if len(d.inputFiles()) == 1 else d


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.lit(0).alias("source_rank"),
        F.col("doc_id").alias("row_idx"),
        F.col("text").alias("transcript"),
        "lang",
        "source",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a verdict, some of them breaking the contract."""
    d = documents(spark, sf_dir).join(labels(spark, sf_dir), "doc_id", "left")
    i = F.col("doc_id")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    kinds = F.array(*[F.lit(k) for k in SPAM_TYPES])
    odd = i % 37 == 0
    word = F.regexp_extract("text", r"^\S+", 0)
    risk = F.when(i % 43 == 0, "extreme").when(toxic & ~odd, "high").otherwise("low")
    kind = (
        F.when(odd, "other")
        .when(toxic, F.get(kinds, (i % 6).cast("int")))
        .otherwise("none")
    )
    spans = (
        F.when(i % 41 == 0, F.array(F.lit("<not in the transcript>")))
        .when(toxic, F.array(word))
        .otherwise(F.array().cast("array<string>"))
    )
    verdict = F.when(i % 47 != 0, make_verdict(risk, kind, "fixture", spans))
    return d.select(
        F.lit(0).alias("source_rank"),
        i.alias("row_idx"),
        F.col("text").alias("transcript"),
        verdict.alias("verdict"),
        "lang",
    )


def gold(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Labelled documents: ``row_idx, gold, quality, domain`` (+ transcript)."""
    d = documents(spark, sf_dir).join(labels(spark, sf_dir), "doc_id")
    columns = [
        F.col("doc_id").alias("row_idx"),
        (F.col("toxic") == 1).alias("gold"),
        "quality",
        F.col("lang").alias("domain"),
        "source",
    ]
    return d.select(*columns, *([F.col("text").alias("transcript")] if text else []))


def raw_output(row_idx: Column, fraud: Column) -> Column:
    """A model output as text: right, wrong or broken by fixed rules."""
    i = row_idx
    flip = i % 7 == 0
    said = F.when(flip, ~fraud).otherwise(fraud)
    risk = (
        F.when(flip, F.when(said, "high").otherwise("low"))
        .when(i % 17 == 0, "extreme")
        .when(said & (i % 5 == 0), "medium")
        .when(said, "high")
        .otherwise("low")
    )
    kind = F.when(said, "other").otherwise("none")
    spans = F.when(i % 23 == 0, '["evidence not present"]').otherwise("[]")
    head = F.concat(
        F.lit('{"risk": "'), risk, F.lit('", "fraud_type": "'), kind, F.lit('"')
    )
    tail = F.concat(F.lit(', "flagged_spans": '), spans, F.lit("}"))
    reason = F.lit(', "reason": "Caller exhibits a scam pattern."')
    good = F.concat(head, reason, tail)
    prose = F.when(i % 2 == 0, F.concat(F.lit("Answer: "), good, F.lit(" end"))).otherwise(good)
    return (
        F.when(flip, prose)
        .when(i % 11 == 0, "not json")
        .when(i % 13 == 0, F.concat(head, tail))
        .when(i % 29 == 0, '{"risk": }')
        .when(i % 31 == 0, F.concat(head, reason, F.lit(', "flagged_spans": [1, 2]}')))
        .when(i % 17 == 0, prose)
        .when(i % 19 == 0, F.concat(head, F.lit(', "reason": 5'), tail))
        .otherwise(prose)
    )


def predictions(gold_rows: DataFrame) -> DataFrame:
    """Add ``raw`` model output and the control's ``base_pred``/``base_score``."""
    q = F.col("quality")
    spread = (F.col("row_idx") % 101) / 202
    return gold_rows.withColumn("raw", raw_output(F.col("row_idx"), F.col("gold"))).select(
        "*",
        (q == 0).alias("base_pred"),
        ((1 - q) * 0.5 + spread).alias("base_score"),
    )


def rai_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("row_idx")
    rows = predictions(gold(spark, sf_dir, text=True))
    return rows.select(
        i.cast("string").alias("case_id"),
        F.when(i % 3 == 0, "benign_demographic")
        .when(i % 3 == 1, "prompt_injection")
        .otherwise("other")
        .alias("category"),
        F.floor(i / 2).cast("string").alias("pair_id"),
        "transcript",
        F.col("gold").alias("expected_is_fraud"),
        F.col("raw").alias("prediction"),
        F.col("domain").alias("candidate"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four attempts per labelled document; valid from attempt ``id % 5`` on."""
    rows = labels(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"),
        (F.col("toxic") == 1).alias("fraud"),
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"),
    )
    good = F.concat(
        F.lit('{"risk": "'), F.when(F.col("fraud"), "high").otherwise("low"),
        F.lit('", "fraud_type": "other", "reason": "attempt '),
        F.col("attempt").cast("string"), F.lit('"}'),
    )
    ok = F.col("attempt") >= F.col("request_id") % 5
    broken = F.when(F.col("attempt") % 2 == 0, "no answer")
    return rows.select("request_id", "attempt", F.when(ok, good).otherwise(broken).alias("raw"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"
    )


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_type").alias("key"), "ts", "event_id", (F.col("value") > 35).alias("is_fraud")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    return events(spark, sf_dir).select(
        "ts",
        F.lit("POST").alias("type"),
        F.col("event_type").alias("name"),
        F.col("event_type").alias("endpoint"),
        F.when(failed, 503).otherwise(200).alias("status"),
        failed.alias("failed"),
        (F.col("event_id") % 10 == 0).alias("invalid"),
        (F.col("value") > 35).alias("is_fraud"),
        F.col("value").alias("latency_ms"),
        F.col("event_type").alias("key"),
        F.col("event_id").alias("request_id"),
    )


def typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call types: the taxonomy words alone, or next to the event type."""
    i = F.col("event_id")
    word = F.get(F.array(*[F.lit(t) for t in CALL_TYPES]), (i % len(CALL_TYPES)).cast("int"))
    kind = (
        F.when(i % 4 == 0, word)
        .when(i % 4 == 1, F.concat(F.lit("  "), F.upper(word), F.lit(" ")))
        .when(i % 4 == 2, F.concat(F.col("event_type"), F.lit(" "), word))
    )
    return events(spark, sf_dir).select(
        i.alias("row_idx"), kind.alias("call_type"), (F.col("value") > 35).alias("is_scam")
    )


def record_of_document(d: DataFrame) -> DataFrame:
    """Documents as call-event records; works on batch and streaming frames."""
    i = F.col("doc_id")
    k = i % 50
    stamp = F.date_format(F.timestamp_seconds(F.lit(EPOCH_2026) + i), "yyyy-MM-dd'T'HH:mm:ss")
    event_id = F.concat(F.lit("evt-"), F.when(k == 1, i - 1).otherwise(i).cast("string"))
    text = F.when(k == 4, "   ").otherwise(F.col("text"))
    body = F.to_json(
        F.struct(
            event_id.alias("event_id"),
            F.when(k == 3, stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("occurred_at"),
            F.when(k != 5, F.col("source")).alias("source"),
            text.alias("transcript"),
        )
    )
    payload = (
        F.when(k == 2, F.concat(F.lit("{"), F.col("text")))
        .when(k == 6, "[1, 2]")
        .when(k == 7, F.concat(body, F.lit(" trailing")))
        .otherwise(body)
    )
    return d.select(
        F.concat(F.lit("calls-"), (i % 3).cast("string")).alias("stream_partition"),
        F.floor(i / 3).alias("source_offset"),
        payload.alias("payload"),
    )


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_of_document(documents(spark, sf_dir))
