"""Call-event ingestion: contract, dead letters, de-duplication, safe replay.

Every micro-batch ends in one write: a ledger folder ``batch_id=N`` partitioned
by ``outcome``. Curated events, dead letters, statistics and offsets are all
views of it, so they cannot disagree, and replaying a batch overwrites its own
folder. A batch counts once its small ``commits/batch_id=N`` file exists; that
file holds the running totals and next offsets of all stream partitions, so
only the latest one is ever read.

A record is skipped if its own position was handled by an earlier batch. The
next offset alone does not decide: files of one drop may arrive in any order
and over many batches.

Raw text is used inside the first projection only and is never stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsieve.functions.contract import with_event
from callsieve.functions.staging import evaluate_once
from callsieve.functions.text import payload_hash, text_features, text_hash
from callsieve.schemas import STREAM_RECORD
from callsieve.session import path_exists, scratch
from callsieve.sources.files import indexed_lines
from callsieve.sources.tail import Bookmark, tail_lines
from callsieve.streaming.seen import add, history_of, merge

LEDGER_SCHEMA = (
    "stream_partition string, source_offset long, event_id string, occurred_at timestamp, "
    "occurred_at_raw string, source string, transcript_hash string, char_count int, "
    "word_count int, turn_count int, digit_ratio double, has_url int, payload_hash string, "
    "error_code string, ingested_at timestamp, outcome string, batch_id long"
)
COMMIT_SCHEMA = (
    "stream_partition string, processed long, accepted long, dead_lettered long, "
    "duplicates long, skipped_by_checkpoint long, next_offset long, batch_id long"
)
ACCEPTED, DUPLICATE, DEAD, SKIPPED = "accepted", "duplicate", "dead_letter", "skipped"

COUNTERS = ("processed", "accepted", "dead_lettered", "duplicates", "skipped_by_checkpoint")


@dataclass(frozen=True)
class StreamStore:
    """Where one stream keeps its tables."""

    root: str

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    @property
    def seen(self) -> str:
        return f"{self.root}/seen"

    @property
    def bookmarks(self) -> str:
        return f"{self.root}/bookmarks"

    @property
    def drops(self) -> str:
        return f"{self.root}/drops"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def latest_commit(spark: SparkSession, store: StreamStore, below: int | None = None) -> int | None:
    """Number of the last batch (before ``below``) that is committed whole; names are listed, no file is read."""
    if not path_exists(spark, store.commits):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(store.commits)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    numbers = sorted((int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")), reverse=True)
    for n in numbers:
        if (below is None or n < below) and path_exists(spark, f"{store.commits}/batch_id={n}/_SUCCESS"):
            return n
    return None


def _commit(spark: SparkSession, store: StreamStore, batch_id: int | None) -> DataFrame:
    if batch_id is None:
        return spark.createDataFrame([], COMMIT_SCHEMA).drop("batch_id")
    return spark.read.schema(COMMIT_SCHEMA).parquet(f"{store.commits}/batch_id={batch_id}").drop("batch_id")


def _committed(spark: SparkSession, store: StreamStore, outcome: str) -> DataFrame:
    last = latest_commit(spark, store)
    done = _read(spark, store.ledger, LEDGER_SCHEMA).filter(F.col("outcome") == outcome)
    return done.filter(F.col("batch_id") <= (-1 if last is None else last))


def curated_events(spark: SparkSession, store: StreamStore) -> DataFrame:
    return _committed(spark, store, ACCEPTED).select(
        "event_id", "stream_partition", "source_offset", "occurred_at", "occurred_at_raw",
        "source", "transcript_hash", "char_count", "word_count", "turn_count", "digit_ratio",
        "has_url", "ingested_at",
    )


def dead_letters(spark: SparkSession, store: StreamStore) -> DataFrame:
    return _committed(spark, store, DEAD).select(
        "stream_partition", "source_offset", "payload_hash", "error_code",
        F.col("ingested_at").alias("recorded_at"),
    )


def stream_statistics(spark: SparkSession, store: StreamStore) -> DataFrame:
    """Totals per stream partition over all committed batches."""
    return _commit(spark, store, latest_commit(spark, store))


def read_event(records: DataFrame) -> DataFrame:
    """Records to contract results and features; the payload ends here.

    Works alike on batch and streaming frames.
    """
    text = F.col("_text")
    staged = evaluate_once(
        with_event(records),
        _text=F.col("event.transcript"),
        _hash=F.when(F.col("event").isNull(), payload_hash(F.col("payload"))),
    )
    return staged.select(
        "stream_partition",
        "source_offset",
        "event.event_id",
        "event.occurred_at",
        "event.occurred_at_raw",
        "event.source",
        text_hash(text).alias("transcript_hash"),
        *[v.alias(k) for k, v in text_features(text).items()],
        F.col("_hash").alias("payload_hash"),
        "error_code",
    )


def first_of_each_event(valid: DataFrame) -> DataFrame:
    """Position of the first record per event id, as ``(event_id, position)``.

    First by stream partition, then offset. Map-side combined, so an id that
    is repeated without end costs one row per map task.
    """
    return valid.groupBy("event_id").agg(
        F.min(F.struct("stream_partition", "source_offset")).alias("_at")
    ).select("event_id", "_at.*")


def resolve_outcomes(records: DataFrame, seen_ids: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` to parsed records of one batch.

    ``records`` has a boolean ``skip`` (handled before). ``seen_ids`` are the accepted
    event ids of earlier batches. The ids of the batch are sent to the history
    first; Spark broadcasts them if they are as small as its own check asks.
    """
    live = records.filter(~F.col("skip") & F.col("error_code").isNull())
    first = first_of_each_event(live.select("event_id", "stream_partition", "source_offset"))
    if seen_ids is not None:
        ids = live.select("event_id").distinct()
        seen_ids = seen_ids.select("event_id").join(ids, "event_id", "left_semi")
        first = first.join(seen_ids, "event_id", "left_anti")
    winner = first.select("stream_partition", "source_offset", F.lit(True).alias("_new"))
    outcome = (
        F.when(F.col("skip"), SKIPPED)
        .when(F.col("error_code").isNotNull(), DEAD)
        .when(F.col("_new"), ACCEPTED)
        .otherwise(DUPLICATE)
    )
    return (
        records.join(winner, ["stream_partition", "source_offset"], "left")
        .withColumn("outcome", outcome)
        .drop("_new")
    )


def outcome_statistics(ledger: DataFrame) -> DataFrame:
    """Counters and next offset per stream partition of a resolved batch."""
    outcome = F.col("outcome")
    live = outcome != SKIPPED
    return ledger.groupBy("stream_partition").agg(
        F.count_if(live).alias("processed"),
        F.count_if(outcome == ACCEPTED).alias("accepted"),
        F.count_if(outcome == DEAD).alias("dead_lettered"),
        F.count_if(outcome == DUPLICATE).alias("duplicates"),
        F.count_if(outcome == SKIPPED).alias("skipped_by_checkpoint"),
        F.max(F.when(live, F.col("source_offset") + 1)).alias("next_offset"),
    )


def repeated_offsets(records: DataFrame) -> DataFrame:
    """Offsets that occur more than once in a partition: must be empty."""
    return (
        records.groupBy("stream_partition", "source_offset")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def _handled_before(
    spark: SparkSession, store: StreamStore, parsed: DataFrame, offsets: DataFrame, batch_id: int
) -> DataFrame:
    """``parsed`` with ``skip``: the record's position is in the ledger of an earlier batch.

    Offsets from a partition's next offset on cannot be, so in the usual case no
    ledger file is opened.
    """
    placed = parsed.join(offsets.select("stream_partition", F.col("next_offset").alias("_next")), "stream_partition", "left")
    below = placed.filter(F.col("source_offset") < F.col("_next")).select("stream_partition", "source_offset")
    if below.isEmpty():
        return placed.drop("_next").withColumn("skip", F.lit(False))
    known = (
        _read(spark, store.ledger, LEDGER_SCHEMA)
        .filter((F.col("batch_id") < batch_id) & (F.col("outcome") != SKIPPED))
        .select("stream_partition", "source_offset")
        .join(below.distinct(), ["stream_partition", "source_offset"], "left_semi")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    return (
        placed.drop("_next").join(known, ["stream_partition", "source_offset"], "left")
        .withColumn("skip", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def running_totals(before: DataFrame, batch: DataFrame) -> DataFrame:
    """Totals with a batch added; the next offset never goes back."""
    return before.unionByName(batch).groupBy("stream_partition").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.max("next_offset").alias("next_offset")
    )


def process_batch(batch: DataFrame, batch_id: int, store: StreamStore) -> None:
    """One micro-batch, all or nothing; running it again changes nothing."""
    spark = batch.sparkSession
    before = _commit(spark, store, latest_commit(spark, store, below=batch_id))
    # A batch may be one file read as one split: records are dealt by position over all cores
    # before they are parsed, so that no batch runs in one task.
    spread = batch.repartition(spark.sparkContext.defaultParallelism, "stream_partition", "source_offset")
    parsed = read_event(spread).persist()
    target = f"{store.ledger}/batch_id={batch_id}"
    done = spark.createDataFrame([], COMMIT_SCHEMA).drop("batch_id")
    try:
        if parsed.count():
            marked = _handled_before(spark, store, parsed, before, batch_id)
            bad = repeated_offsets(marked.filter(~F.col("skip"))).first()
            if bad:
                raise ValueError(
                    "stream offsets must be strictly increasing: "
                    f"{bad['stream_partition']}/{bad['source_offset']} occurs {bad['n']} times"
                )
            merge(spark, store.seen, batch_id)
            history = None
            if batch_id:
                live = marked.filter(~F.col("skip") & F.col("error_code").isNull()).select("event_id").distinct()
                history = history_of(live, store.seen, batch_id)
            if history is None and path_exists(spark, store.ledger):  # no runs of ids: the ledger itself
                history = (
                    _read(spark, store.ledger, LEDGER_SCHEMA)
                    .filter((F.col("outcome") == ACCEPTED) & (F.col("batch_id") < batch_id))
                    .select("event_id")
                )
            (
                resolve_outcomes(marked, history)
                .withColumn("ingested_at", F.current_timestamp())
                .drop("skip")
                .write.mode("overwrite").partitionBy("outcome").parquet(target)
            )
            ledger = spark.read.option("basePath", store.ledger).schema(LEDGER_SCHEMA).parquet(target)
            add(ledger.filter(F.col("outcome") == ACCEPTED).select("event_id"), store.seen, batch_id)
            done = outcome_statistics(ledger)
        else:
            add(spark.createDataFrame([], "event_id string"), store.seen, batch_id)
        running_totals(before, done).coalesce(1).write.mode("overwrite").parquet(
            f"{store.commits}/batch_id={batch_id}"
        )
    finally:
        parsed.unpersist()


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of record drops: immutable files of ``STREAM_RECORD`` rows.

    A broker source offers the same three columns as partition, offset, value.
    """
    return (
        spark.readStream.schema(STREAM_RECORD)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .parquet(path)
    )


def start_ingestion(
    records: DataFrame, store: StreamStore, trigger: dict | None = None
) -> StreamingQuery:
    """Start the stream; by default it handles what is there and stops."""
    return (
        records.writeStream.foreachBatch(lambda df, n: process_batch(df, n, store))
        .option("checkpointLocation", store.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_ingestion(records: DataFrame, store: StreamStore) -> None:
    """Handle everything available and return; failures are raised."""
    start_ingestion(records, store).awaitTermination()


def _bookmark(spark: SparkSession, store: StreamStore, name: str) -> Bookmark | None:
    """The byte that a number of lines of a partition ends at, if it has been noted."""
    noted = f"{store.bookmarks}/{name}"
    if not path_exists(spark, f"{noted}/_SUCCESS"):
        return None
    return Bookmark(*spark.read.schema("lines long, byte long").json(noted).first())


def land_jsonl(
    spark: SparkSession, path: str, store: StreamStore, stream_partition: str
) -> None:
    """Turn the new lines of an append-only JSONL file into a record drop.

    The drop is a folder named by partition and first offset. Lines below the
    committed offset are not landed again, and a drop that is there is left
    alone: the stream may have listed its files. Blank lines are records too and
    keep their offset. Each drop notes the byte that its lines end at; the next one reads
    from there on. Without such a note, or where tasks cannot open the file by themselves,
    all lines are read and those before the offset left out, with the same result.
    """
    found = (
        stream_statistics(spark, store)
        .filter(F.col("stream_partition") == stream_partition)
        .select("next_offset")
        .first()
    )
    start = (found["next_offset"] or 0) if found else 0
    partition = quote(stream_partition, safe="")
    target = f"{store.drops}/{partition}-{start:020d}"
    if path_exists(spark, f"{target}/_SUCCESS"):
        return
    with scratch(spark):
        since = Bookmark(0, 0) if start == 0 else _bookmark(spark, store, f"{partition}-{start:020d}")
        tail = tail_lines(spark, path, since) if since else None
        if tail:
            lines, reached = tail
        else:
            lines, reached = indexed_lines(spark, path, skip_blank=False).filter(F.col("row_idx") >= start), None
        if lines.isEmpty():
            return
        lines.select(
            F.lit(stream_partition).alias("stream_partition"),
            F.col("row_idx").alias("source_offset"),
            F.col("value").alias("payload"),
        ).write.mode("overwrite").parquet(target)
    if reached is not None:
        end = start + spark.read.schema(STREAM_RECORD).parquet(target).count()
        note = spark.createDataFrame([(end, reached)], "lines long, byte long").coalesce(1)
        note.write.mode("overwrite").json(f"{store.bookmarks}/{partition}-{end:020d}")


def process_jsonl(
    spark: SparkSession, path: str, store: StreamStore, stream_partition: str
) -> DataFrame:
    """Land and ingest the new lines of a file; returns what this call has added.

    Drops of a call that broke off are ingested first, so that landing starts at
    the offset they reach.
    """
    rows = {r["stream_partition"]: r for r in stream_statistics(spark, store).collect()}
    before = rows.get(stream_partition)
    if path_exists(spark, store.drops):
        run_ingestion(record_stream(spark, store.drops), store)
    land_jsonl(spark, path, store, stream_partition)
    if path_exists(spark, store.drops):
        run_ingestion(record_stream(spark, store.drops), store)
    return stream_statistics(spark, store).filter(F.col("stream_partition") == stream_partition).select(
        "stream_partition", *[(F.col(c) - (before[c] if before else 0)).alias(c) for c in COUNTERS], "next_offset"
    )


def bounded_dedup(records: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Streaming alternative with bounded state: repeats within a horizon.

    Which of two records of one trigger survives is not defined here; use the
    ledger where the first must win.
    """
    valid = read_event(records).filter(F.col("error_code").isNull())
    return valid.withWatermark("occurred_at", horizon).dropDuplicatesWithinWatermark(["event_id"])


def first_events(records: DataFrame) -> DataFrame:
    """First record per event id over all history, held in the state store.

    The ledger looks ids up in a scan of earlier ids, which grows with history.
    Here a micro-batch touches only the state of its own ids (use the RocksDB
    provider for a large state). ``current_timestamp`` is fixed per batch and
    logged, so a replayed batch computes the same rows. Update mode emits the
    ids of the batch; ``is_new`` marks those it has seen for the first time.
    """
    valid = read_event(records).filter(F.col("error_code").isNull()).drop("error_code", "payload_hash")
    arrived = valid.withColumn("_batch", F.current_timestamp())
    rest = [c for c in valid.columns if c != "event_id"]
    first = F.min_by(
        F.struct("_batch", *rest), F.struct("_batch", "stream_partition", "source_offset")
    )
    return (
        arrived.groupBy("event_id")
        .agg(first.alias("first"), F.max("_batch").alias("_latest"))
        .select(
            "event_id",
            *[F.col(f"first.{c}").alias(c) for c in rest],
            (F.col("first._batch") == F.col("_latest")).alias("is_new"),
        )
    )


def start_state_ingestion(
    records: DataFrame, store: StreamStore, trigger: dict | None = None
) -> StreamingQuery:
    """Curated events by way of the state store, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter("is_new").drop("is_new")
        new.write.mode("overwrite").parquet(f"{store.root}/events/batch_id={batch_id}")

    return (
        first_events(records).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{store.root}/state-checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
