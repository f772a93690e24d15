"""Labelled corpora with different column names, unified onto one pair shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsieve.functions.staging import evaluate_once
from callsieve.functions.text import fingerprint
from callsieve.functions.verdict import call_verdict, domain_verdict, email_verdict
from callsieve.operators.dedup import keep_first
from callsieve.operators.ordering import ordinal


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@dataclass(frozen=True)
class SourceSpec:
    """How one landed source maps onto pairs."""

    name: str
    text: str = "dialogue"
    label: str = "label"
    type: str | None = None
    family: str = "call"  # call | email | domain
    domain: str | None = None
    position: str = "row_idx"

    @property
    def schema(self) -> T.StructType:
        fields = _text(self.text, *([self.type] if self.type else []))
        label = T.StringType() if self.family == "email" else T.IntegerType()
        return fields.add(self.label, label)


# Source shapes by dataset name; paths are given at load time, one per spec.
CORPORA: dict[str, tuple[SourceSpec, ...]] = {
    "prototype": (
        SourceSpec("prototype-train", type="type"),
        SourceSpec("prototype-test", type="type"),
    ),
    "calls": (
        SourceSpec("phone-scam"),
        SourceSpec("phone-scam-synthetic", type="type"),
        SourceSpec("multi-agent", label="labels", type="type"),
        SourceSpec("single-agent", label="labels", type="type"),
    ),
    "email": (SourceSpec("email", text="text", family="email"),),
    "domains": tuple(
        SourceSpec(d, text="text", family="domain", domain=d)
        for d in ("phishing", "job_scams", "sms")
    ),
}
# Exams for other channels: never split, everything is test.
EVAL_ONLY = frozenset({"email", "domains"})


def verdict_of(spec: SourceSpec) -> Column:
    label = F.col(spec.label)
    if spec.family == "email":
        return email_verdict(label)
    if spec.family == "domain":
        return domain_verdict(label, F.lit(spec.domain))
    kind = F.col(spec.type) if spec.type else F.lit(None).cast("string")
    return call_verdict(label.cast("int") == 1, kind)


def to_pairs(frame: DataFrame, spec: SourceSpec, rank: int) -> DataFrame:
    """One source as pairs: a projection, nothing moves."""
    return evaluate_once(frame, verdict=verdict_of(spec)).select(
        F.lit(rank).cast("int").alias("source_rank"),
        F.col(spec.position).cast("long").alias("row_idx"),
        F.col(spec.text).alias("transcript"),
        "verdict",
    )


def unify(sources: Sequence[tuple[SourceSpec, DataFrame]]) -> DataFrame:
    """UNION ALL of all sources in list order."""
    frames = [to_pairs(frame, spec, rank) for rank, (spec, frame) in enumerate(sources)]
    pairs = frames[0]
    for frame in frames[1:]:
        pairs = pairs.unionByName(frame)
    return pairs


def unique_positions(pairs: DataFrame) -> DataFrame:
    """``pairs``, after a look at the positions alone: one that occurs twice raises."""
    again = pairs.groupBy("source_rank", "row_idx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if again:
        raise ValueError(f"source {again['source_rank']} has {again['n']} rows at position {again['row_idx']}")
    return pairs


def first_of_each_text(pairs: DataFrame) -> DataFrame:
    """Loader rule: the first row of every normalised text, before any check.

    A missing text is no text to compare, so each such row is kept and left
    to the quality gate, which names the reason.
    """
    keyed = unique_positions(pairs).withColumn("ordinal", ordinal(F.col("source_rank"), F.col("row_idx")))
    own = F.concat(F.lit("missing:"), F.col("ordinal").cast("string"))
    text = F.col("transcript")
    keyed = keyed.withColumn("fingerprint", F.when(text.isNull(), own).otherwise(fingerprint(text)))
    return keep_first(keyed, "fingerprint").drop("ordinal", "fingerprint")


def load_corpus(
    spark: SparkSession,
    dataset: str,
    paths: Sequence[str],
    reader: Callable[[SparkSession, str, T.StructType], DataFrame],
    deduplicate: bool | None = None,
) -> DataFrame:
    """Pairs of a named dataset from landed files, one path per source.

    ``reader`` returns the declared columns and ``row_idx``. Only the call
    corpus is de-duplicated while loading.
    """
    specs = CORPORA[dataset]
    if len(specs) != len(paths):
        raise ValueError(f"{dataset} needs {len(specs)} paths, got {len(paths)}")
    pairs = unify([(s, reader(spark, p, s.schema)) for s, p in zip(specs, paths)])
    if deduplicate is None:
        deduplicate = dataset == "calls"
    return first_of_each_text(pairs) if deduplicate else pairs
