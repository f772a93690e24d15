"""Physical plans: what must not come back unnoticed."""

from pyspark.sql import functions as F

from callsieve.operators import dedup, drift, quality, split
from callsieve.plans import inputs as I
from callsieve.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_work_never_gathers_in_one_task(spark):
    for name in ("drift_rolling", "drift_status", "accepted_pairs", "first_wins_dedup", "contract_quarantine",
                 "feature_upsert", "rai_checks", "retry_resolution", "error_summary", "model_metrics",
                 "review_sample", "live_rates", "request_rate", "latency_p95", "event_contract"):
        text = plan(QUERIES[name](spark, SF))
        assert "SinglePartition" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_no_python_workers_in_any_batch_query(spark):
    for name, query in QUERIES.items():
        if name.startswith("stream_"):
            continue
        text = plan(query(spark, SF))
        assert "Python" not in text and "Pandas" not in text, name


def test_top_k_is_cut_before_the_shuffle(spark):
    for df in (drift.drift_status(I.served(spark, SF)), QUERIES["review_sample"](spark, SF)):
        assert "WindowGroupLimit" in plan(df)


def test_quarantine_moves_no_text(spark):
    text = plan(quality.quarantine(I.pairs(spark, SF).select("source_rank", "row_idx", "transcript", "verdict")))
    tops = [line for line in text.split("\n") if "SortMergeJoin" in line or "Exchange hashpartitioning(ordinal" in line]
    assert tops and not any("transcript#" in line for line in tops)


def test_split_shuffles_no_rows(spark):
    """Rows are labelled by comparison: the row branch has no exchange."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("row_key"), "text", (F.col("lang") == "en").alias("is_fraud"))
    text = plan(split.stratified_split(df))
    row_branch = text.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in row_branch and "Exchange hashpartitioning" not in row_branch
    # Pre-counts read the key and the label only.
    assert text.count("ReadSchema: struct<doc_id:bigint,text:string,lang:string>") == 1


def test_dedup_uses_hash_aggregation_and_a_unique_join_key(spark):
    d = I.documents(spark, SF).select(F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("fingerprint"))
    text = plan(dedup.keep_first(d, "fingerprint"))
    assert "SortAggregate" not in text and "HashAggregate" in text and "LeftSemi" in text


def test_scans_are_pruned(spark):
    text = plan(QUERIES["drift_status"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in text
