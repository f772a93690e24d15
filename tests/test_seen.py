import json
import random

from callsieve.streaming import ingest as I
from callsieve.streaming import seen


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "event_id string")


def test_finds_all_repeats_and_opens_few_buckets(spark, folder):
    root = f"{folder}/seen"
    for n in range(3):
        seen.add(ids(spark, [f"e{n}-{i}" for i in range(500)]), root, n)
    assert seen.live_runs(spark, root, 3) == ["0-0", "0-1", "0-2"]
    known = [f"e{n}-{i}" for n in range(3) for i in range(0, 500, 7)]
    found = {r.event_id for r in seen.history_of(ids(spark, known), root, 3).collect()}
    assert set(known) <= found
    assert len(seen.may_hold(ids(spark, ["e1-5"]), root, ["0-0", "0-1", "0-2"])) == 1
    fresh = seen.may_hold(ids(spark, [f"new{i}" for i in range(50)]), root, ["0-0", "0-1", "0-2"])
    assert len(fresh) <= 5  # 150 questions
    assert seen.history_of(ids(spark, []), root, 3).count() == 0


def test_runs_are_merged_and_stay_few(spark, folder, monkeypatch):
    monkeypatch.setattr(seen, "FAN", 2)
    root, rng = f"{folder}/seen", random.Random(2)
    batches = []
    for n in range(7):
        seen.merge(spark, root, n)
        runs = seen.live_runs(spark, root, n)
        assert runs is not None and len(runs) <= 3
        batches.append([f"{n}-{i}" for i in range(rng.choice([0, 3, 20]))])
        seen.add(ids(spark, batches[-1]), root, n)
    seen.merge(spark, root, 8)
    assert seen.live_runs(spark, root, 7) == ["2-0", "1-4", "0-6"]
    everything = [x for b in batches for x in b]
    assert {r.event_id for r in seen.history_of(ids(spark, everything), root, 7).collect()} >= set(everything)
    assert seen.live_runs(spark, root, 9) is None  # batch 7 and 8 have no run


def test_stream_over_many_batches_equals_the_ledger_scan(spark, folder, monkeypatch):
    monkeypatch.setattr(seen, "FAN", 2)
    event = lambda e: json.dumps({"event_id": e, "occurred_at": "2031-02-03T04:05:06Z", "source": "s", "transcript": "some text"})
    rng = random.Random(9)
    with_runs, without = I.StreamStore(f"{folder}/a"), I.StreamStore(f"{folder}/b")
    offset = 0
    for n in range(5):
        rows = [("p", offset + i, event(f"e{rng.randrange(40)}")) for i in range(12)]
        offset += len(rows)
        batch = spark.createDataFrame(rows, I.STREAM_RECORD)
        I.process_batch(batch, n, with_runs)
        if n == 3:
            I.process_batch(batch, n, with_runs)  # a replay, after runs were merged for it
        with monkeypatch.context() as m:
            m.setattr(I, "history_of", lambda *_: None)
            I.process_batch(batch, n, without)
    stats = [[tuple(r) for r in I.stream_statistics(spark, s).collect()] for s in (with_runs, without)]
    assert stats[0] == stats[1]
    kept = [sorted((r.event_id, r.source_offset) for r in I.curated_events(spark, s).collect()) for s in (with_runs, without)]
    assert kept[0] == kept[1] and len(kept[0]) == len({e for e, _ in kept[0]})
