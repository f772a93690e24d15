import glob
import os

from pyspark.sql import functions as F

from callsieve.plans import inputs as I
from callsieve.plans import queries as Q
from callsieve.session import shared_dir

SF = "/root/testdata/sf0.001"


def test_predictions_in_order_written_by_more_than_three_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [r.raw_sha for r in Q.predictions_in_order(spark, SF).orderBy("row_idx").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    written = max(glob.glob(f"{root}/ordered-*.jsonl"), key=os.path.getmtime)
    assert len(glob.glob(f"{written}/part-*")) > 3
    want = [r.s for r in I.documents(spark, SF).orderBy("doc_id").select(F.sha2("text", 256).alias("s")).collect()]
    assert got == want


def test_corpus_from_files_lands_more_than_three_files_a_source(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(Q.corpus_from_files(spark, SF).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    landed = max(glob.glob(f"{root}/landed-*"), key=os.path.getmtime)
    assert min(len(glob.glob(f"{d}/part-*")) for d in glob.glob(f"{landed}/*")) > 3
    assert got == sorted(Q.corpus_union(spark, SF).collect())
