"""Readers with declared schemas and explicit row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsieve import schemas as S
from callsieve.functions.text import extract_transcript, is_blank
from callsieve.functions.verdict import is_fraud, with_verdict
from callsieve.session import fresh_dir
from callsieve.sources.feature_table import read_features  # noqa: F401 - one of the readers

# Keys a prediction record may use; the first one present is read.
PREDICTION_KEYS = ("prediction", "completion", "output")


def indexed_lines(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """``(file, row_idx, value)``: every line with its position among all files.

    Files count in the order of their paths, so the position is unique over a
    folder. Large files are read in blocks by many tasks. Where Spark cuts them depends on
    settings and on how many cores there are at the time, so the lines are written once,
    with the block that they were read in and their number; positions come from that
    table alone and hold however it is read later. A small table has the first position of
    each block, and lines stay where they are while it is below Spark's broadcast
    threshold. A compressed file cannot be cut and is one block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value"
    )
    if skip_blank:
        lines = lines.filter(~is_blank(F.col("value")))
    # Numbers within a task follow the order of reading and have no gaps.
    lines = _stored(lines.withColumn("_seq", F.monotonically_increasing_id()), "lines")
    upto = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        lines.groupBy("file", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
        .withColumn("_start", F.sum("_n").over(upto) - F.col("_n"))
        .drop("_n")
    )
    return lines.join(_stored(starts, "blocks"), ["file", "_block"]).select(
        "file", (F.col("_start") + F.col("_seq") - F.col("_first")).alias("row_idx"), "value"
    )


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    where = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with ``row_idx``; a malformed line fails the job.

    A ``row_idx`` in the record, as our own writers leave it, wins over the
    position of the line, so a folder of many files keeps its order.
    """
    own = T.StructType([*schema.fields, T.StructField("row_idx", T.LongType())])
    record = F.from_json("value", own, {"mode": "FAILFAST"})
    return indexed_lines(spark, path).select("row_idx", record.alias("r")).select(
        F.coalesce("r.row_idx", "row_idx").alias("row_idx"), *[f"r.{f.name}" for f in schema.fields]
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, prompt, completion)`` of one split file."""
    return read_json_lines(spark, path, S.EXAMPLE)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return read_examples(spark, path).select("row_idx", "prompt")


def gold_of_examples(examples: DataFrame) -> DataFrame:
    """Transcript, gold verdict and label of instruction examples.

    A completion that is not a valid verdict fails the job: gold must be clean.
    """
    parsed = with_verdict(examples, "completion")
    checked = F.when(F.col("failure").isNull(), F.col("verdict")).otherwise(
        F.raise_error(
            F.concat(F.lit("gold completion failed schema parse: "), F.col("completion"))
        )
    )
    return parsed.withColumn("verdict", checked).select(
        *[c for c in examples.columns if c not in ("prompt", "completion")],
        extract_transcript(F.col("prompt")).alias("transcript"),
        "verdict",
        is_fraud(F.col("verdict.risk")).alias("gold"),
        "completion",
    )


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return gold_of_examples(read_examples(spark, path))


def prediction_of_record(record: Column) -> Column:
    """Raw output of a JSON record. Presence of a key decides, not its value."""
    value = F.parse_json(record)
    chain = F.raise_error(F.concat(F.lit("no prediction/completion/output key in "), record))
    for key in reversed(PREDICTION_KEYS):
        present = F.try_variant_get(value, f"$.{key}", "variant").isNotNull()
        chain = F.when(present, F.try_variant_get(value, f"$.{key}", "string")).otherwise(chain)
    return chain


def load_predictions(spark: SparkSession, path: str, json_records: bool | None = None) -> DataFrame:
    """``(row_idx, raw)``: JSON records (by default of ``.jsonl`` paths), or one raw output per line."""
    if json_records is None:
        json_records = path.rstrip("/").endswith(".jsonl")
    lines = indexed_lines(spark, path)
    if not json_records:
        return lines.select("row_idx", F.col("value").alias("raw"))
    own = F.get_json_object("value", "$.row_idx").try_cast("long")
    return lines.select(
        F.coalesce(own, "row_idx").alias("row_idx"),
        prediction_of_record(F.col("value")).alias("raw"),
    )


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Responsible-AI cases; blank lines are skipped, a malformed one fails the job."""
    return spark.read.schema(S.RAI_CASE).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A whole-file JSON document (manifest, metrics, operational, RAI); a broken one fails the job."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def stream_table(spark: SparkSession, base: str, name: str, schema: str, **options) -> DataFrame:
    """Stream a Parquet table that is a folder of files or one single file.

    The file source watches folders, so a single file is picked from its own.
    """
    path = f"{base}/{name}.parquet"
    reader = spark.readStream.schema(schema).options(**options)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)
