"""A corpus through five operators: judged, identified, de-duplicated, decontaminated, tokenized."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.llm import bpe, decontaminate, langid, ngram_join, quality_bayes
from callsieve.llm.grouping import written
from callsieve.session import configure, fresh_dir, remove_path, scratch


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = configure(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_bayes.judge_documents(docs, labels, "source", "lang").filter("accepted").select(*docs.columns)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the dictionaries come from all of them."""
    return langid.classify(docs, langid.fit(docs)).filter("accepted").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_similar(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, benchmark)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: token ids as little-endian 32-bit integers, and what they spell."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", judge),
    ("language identification", identify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE encoding and decoding", tokenize),
]

#: The classifier and the language model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next.

    What a stage has written on its way goes when its result is there, and that goes when the
    next stage has ended: never more than two copies of the corpus are in the shared folder.
    """
    docs, path = configure(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before, path = path, fresh_dir(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove_path(spark, before)
    return docs
