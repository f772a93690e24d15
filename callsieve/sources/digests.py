"""Digests of files of any size: block by block, folded in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.session import fresh_dir
from callsieve.sources.tail import open_path

BLOCK_BYTES = 64 << 20
#: Bytes held at a time while a block is digested.
PIECE = 1 << 20
_BLOCKS = "path string, length long, block long, digest string"


def file_block_digests(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """``path, length, block, digest``: SHA-256 of each block of the files of a folder, or of one file.

    Files that begin with a dot or an underscore do not count. The driver lists names and lengths;
    blocks are read by tasks, a piece at a time, and only digests are written.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True)
    rows = []
    while found.hasNext():
        status = found.next()
        name = status.getPath()
        if name.getName()[0] not in "._":
            size = status.getLen()
            rows += [(name.toString(), size, k, k * block, min(size, (k + 1) * block)) for k in range(max(1, -(-size // block)))]
    ranges = spark.createDataFrame(rows, "path string, length long, block long, a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "a", "b"))):
                system, inner = open_path(name)
                h = hashlib.sha256()
                with system.open_input_file(inner) as source:
                    source.seek(a)
                    while a < b:
                        piece = source.read(min(PIECE, b - a))
                        if not piece:
                            raise ValueError(f"{name} has become shorter")
                        h.update(piece)
                        a += len(piece)
                made.append(h.hexdigest())
            if made:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "length", "block")), pa.array(made)], ["path", "length", "block", "digest"])

    where = fresh_dir(spark, "digests")
    if rows:
        ranges = ranges.repartition(min(len(rows), 10_000), "path", "block")
    ranges.mapInArrow(run, _BLOCKS).write.parquet(where)
    return spark.read.schema(_BLOCKS).parquet(where)


def folded_digests(blocks: DataFrame) -> DataFrame:
    """``path, length, sha256``: the SHA-256 of a file's block digests in order.

    A file of one block has its plain SHA-256. A file of a petabyte has 16 million digests.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    files = blocks.groupBy("path", "length").agg(ordered.alias("d"))
    folded = F.sha2(F.unhex(F.array_join("d", "")), 256)
    return files.select("path", "length", F.when(F.size("d") == 1, F.col("d")[0]).otherwise(folded).alias("sha256"))
