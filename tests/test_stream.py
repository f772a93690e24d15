import json
import random

import pytest
from pyspark.sql import functions as F

from callsieve.streaming import ingest as I


def event(event_id, transcript="The gardener waters 12 roses", at="2031-02-03T04:05:06Z"):
    return json.dumps({"event_id": event_id, "occurred_at": at, "source": "desk-7", "transcript": transcript})


MIXED = ["[1, 2", event("rose", "See http://garden.example/rose now"), event("lily", ""), event("oak"), event("rose", "again"), event("elm")]
FIELDS = ("processed", "accepted", "dead_lettered", "duplicates", "skipped_by_checkpoint", "next_offset")


def drop(spark, store, partition, start, payloads):
    rows = [(partition, start + i, p) for i, p in enumerate(payloads)]
    spark.createDataFrame(rows, I.STREAM_RECORD).coalesce(1).write.mode("append").parquet(store.drops)


def run(spark, store, files=100):
    I.run_ingestion(I.record_stream(spark, store.drops, files), store)


def stats(spark, store):
    return {r.stream_partition: tuple(r[f] for f in FIELDS) for r in I.stream_statistics(spark, store).collect()}


def test_jsonl_file_read_in_several_calls(spark, tmp_path, folder):
    """Six lines, nothing new, then two more of which one is blank."""
    file, store = tmp_path / "desk.jsonl", I.StreamStore(f"{folder}/s")
    file.write_text("\n".join(MIXED) + "\n")
    call = lambda: tuple(I.process_jsonl(spark, f"file://{file}", store, "desk/7").select(*FIELDS).first())
    assert call() == (6, 3, 2, 1, 0, 6)
    assert call() == (0, 0, 0, 0, 0, 6)
    curated = I.curated_events(spark, store).orderBy("event_id").collect()
    assert [(r.event_id, r.has_url, r.source_offset) for r in curated] == [("elm", 0, 5), ("oak", 0, 3), ("rose", 1, 1)]
    dead = I.dead_letters(spark, store).orderBy("source_offset").collect()
    assert [(r.source_offset, r.error_code) for r in dead] == [(0, "invalid_json"), (2, "invalid_event:transcript:string_too_short")]
    assert all(len(r.payload_hash) == 64 for r in dead) and "[1, 2" not in str(dead)
    with file.open("a") as f:
        f.write("\n" + event("ash") + "\n")
    assert call() == (2, 1, 1, 0, 0, 8)
    assert "gardener" not in spark.read.parquet(store.ledger).toPandas().to_string()


def test_landing_twice_and_more_files_than_a_batch_takes(spark, tmp_path, folder):
    file, store = tmp_path / "long.jsonl", I.StreamStore(f"{folder}/s")
    file.write_text("".join(event(f"e{i}") + "\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        I.land_jsonl(spark, f"file://{file}", store, "p")
        I.land_jsonl(spark, f"file://{file}", store, "p")
        run(spark, store, files=4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stats(spark, store) == {"p": (300, 300, 0, 0, 0, 300)}
    assert I.latest_commit(spark, store) > 2


def test_later_offsets_may_arrive_first(spark, folder):
    store = I.StreamStore(f"{folder}/s")
    drop(spark, store, "p", 5, [event(f"e{i}") for i in range(5, 10)])
    run(spark, store, files=1)
    drop(spark, store, "p", 0, [event(f"e{i}") for i in range(5)])
    drop(spark, store, "p", 3, [event("e3"), event("e4"), event("e5")])
    run(spark, store, files=1)
    assert stats(spark, store) == {"p": (10, 10, 0, 0, 3, 10)}


def test_event_id_is_unique_across_partitions_and_batches(spark, folder):
    store = I.StreamStore(f"{folder}/s")
    drop(spark, store, "b", 0, [event("x"), event("y")])
    drop(spark, store, "a", 0, [event("x"), event("x")])
    run(spark, store)
    kept = {(r.event_id, r.stream_partition, r.source_offset) for r in I.curated_events(spark, store).collect()}
    assert kept == {("x", "a", 0), ("y", "b", 1)}
    drop(spark, store, "a", 2, [event("y"), event("z")])
    run(spark, store)
    assert stats(spark, store) == {"a": (4, 2, 0, 2, 0, 4), "b": (2, 1, 0, 1, 0, 2)}


def test_replayed_batch_changes_nothing(spark, folder):
    """A batch that failed half way or is run twice leaves one result."""
    store = I.StreamStore(f"{folder}/s")
    first = spark.createDataFrame([("p", i, v) for i, v in enumerate(MIXED)], I.STREAM_RECORD)
    second = spark.createDataFrame([("p", 6, event("rose")), ("p", 7, event("fir"))], I.STREAM_RECORD)
    I.process_batch(first, 0, store)
    for _ in range(3):
        I.process_batch(second, 1, store)
    assert stats(spark, store) == {"p": (8, 4, 2, 2, 0, 8)}
    assert I.curated_events(spark, store).count() == 4


def test_uncommitted_ledger_is_not_visible(spark, folder, monkeypatch):
    store = I.StreamStore(f"{folder}/s")
    batch = spark.createDataFrame([("p", 0, event("a"))], I.STREAM_RECORD)
    monkeypatch.setattr(I, "outcome_statistics", lambda _: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        I.process_batch(batch, 0, store)
    assert I.curated_events(spark, store).count() == 0
    monkeypatch.undo()
    I.process_batch(batch, 0, store)
    assert I.curated_events(spark, store).count() == 1


def test_offsets_below_the_checkpoint_are_skipped_and_repeats_refused(spark, folder):
    store = I.StreamStore(f"{folder}/s")
    make = lambda *o: spark.createDataFrame([("p", i, event(f"e{i}")) for i in o], I.STREAM_RECORD)
    I.process_batch(make(0, 1), 0, store)
    I.process_batch(make(1, 2), 1, store)
    assert stats(spark, store) == {"p": (3, 3, 0, 0, 1, 3)}
    with pytest.raises(ValueError, match="strictly increasing"):
        I.process_batch(make(3, 3), 2, store)


def test_hot_event_id(spark, folder):
    df = spark.range(1500).select(
        F.lit("p").alias("stream_partition"), F.col("id").alias("source_offset"),
        F.when(F.col("id") % 3 == 0, event("hot")).otherwise(
            F.concat(F.lit('{"event_id":"'), F.col("id").cast("string"),
                     F.lit('","occurred_at":"2026-07-23T10:00:00Z","source":"s","transcript":"t"}'))).alias("payload"),
    )
    r = I.outcome_statistics(I.resolve_outcomes(I.read_event(df).withColumn("skip", F.lit(False)))).first()
    assert (r.processed, r.accepted, r.duplicates) == (1500, 1001, 499)


def test_bounded_dedup_runs_as_a_stream(spark, folder):
    store = I.StreamStore(f"{folder}/s")
    drop(spark, store, "p", 0, [event("a"), event("a"), event("b")])
    q = (I.bounded_dedup(I.record_stream(spark, store.drops)).writeStream.format("memory").queryName("bounded")
         .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("bounded").count() == 2


def test_state_store_keeps_the_first_over_all_history(spark, folder):
    store = I.StreamStore(f"{folder}/s")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for start, a, b in ((0, [event("x"), event("x")], [event("x"), event("y")]), (2, [event("y"), event("z")], ["{bad"])):
            drop(spark, store, "a", start, a)
            drop(spark, store, "b", start, b)
            I.start_state_ingestion(I.record_stream(spark, store.drops), store).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{store.root}/events").collect()
    assert {(r.event_id, r.stream_partition, r.source_offset) for r in got} == {("x", "a", 0), ("y", "b", 1), ("z", "a", 3)}
    assert len(got) == 3


def test_a_batch_of_one_file_is_parsed_by_many_tasks(spark, folder, monkeypatch):
    """A large batch that arrives as one split is still parsed in several parts."""
    store = I.StreamStore(f"{folder}/s")
    parsed = []
    monkeypatch.setattr(I, "read_event", lambda b, real=I.read_event: parsed.append(b) or real(b))
    words = random.Random(7)
    rows = [("p", i, event(f"e{i}", " ".join(f"{words.getrandbits(64):x}" for _ in range(100)))) for i in range(4000)]
    I.process_batch(spark.createDataFrame(rows, I.STREAM_RECORD).coalesce(1), 0, store)
    parts = parsed[0].select(F.spark_partition_id().alias("part"), F.length("payload").alias("n"))
    assert parts.groupBy("part").agg(F.sum("n")).count() > 1
    assert stats(spark, store) == {"p": (4000, 4000, 0, 0, 0, 4000)}
