"""The end of a growing file of lines: only bytes after a bookmark are read.

The driver knows the file's length and cuts what is new into blocks; tasks read a block each
and hand on the lines that begin in it. Positions come from numbers of lines by block,
so nothing is collected and nothing is read twice but the one line that crosses a cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsieve.session import fresh_dir, scratch

#: Most bytes of a block; fewer where Spark is told to cut files smaller.
BLOCK_BYTES = 16 << 20
#: Bytes read at a time beyond a block, to end its last line.
AHEAD = 64 << 10
_END = re.compile(rb"\r\n|\n|\r")


class Bookmark(NamedTuple):
    """The first ``lines`` lines of a file are its first ``byte`` bytes."""

    lines: int
    byte: int


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as tasks open it; raises where there is none for its scheme."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def file_length(path: str) -> int | None:
    """Bytes of a file, None if it cannot be opened without Spark or is no file."""
    try:
        system, name = open_path(path)
        info = system.get_file_info(name)
    except (ValueError, OSError, pa.ArrowException):
        return None
    return info.size if info.is_file else None


def _lines_of(source, start: int, end: int, first: int) -> Iterator[str]:
    """Lines that begin in ``[start, end)``. ``first`` is where the new bytes begin, which may be within a line."""
    at = max(start - 1, 0)  # the byte before tells whether a line begins here
    source.seek(at)
    data = source.read(end - at)
    size = source.size()
    while at + len(data) < size and not _ended(data, end - at):
        more = source.read(AHEAD)
        if not more:
            break
        data += more
    begin = 0
    if start > 0:
        if start == first and data[:1] == b"\r" and data[1:2] != b"\n":
            begin = 1
        else:
            found = _END.search(data)
            begin = found.end() if found else len(data)
    while at + begin < end and begin < len(data):
        found = _END.search(data, begin)
        stop = found.start() if found else len(data)
        yield data[begin:stop].decode("utf-8", "replace")
        begin = found.end() if found else len(data)


def _ended(data: bytes, size: int) -> bool:
    """Whether the last line that begins in the first ``size`` bytes is known to the end."""
    found = _END.search(data, max(size - 1, 0))
    return found is not None and (found.end() < len(data) or found[0] != b"\r")


def _block_bytes(spark: SparkSession) -> int:
    told = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return min(BLOCK_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told))


def tail_lines(spark: SparkSession, path: str, since: Bookmark, block: int | None = None) -> tuple[DataFrame, int] | None:
    """``(row_idx, value)`` of the lines after a bookmark, and the length of the file that they reach to.

    None if the file cannot be read this way or is shorter than the bookmark. Lines end at CR,
    LF or both, blank ones count, and the last one needs no end; what is added to such a line
    later is not a new line, as its position has been taken.
    """
    size = file_length(path)
    if size is None or size < since.byte:
        return None
    first = since.byte
    block = block or _block_bytes(spark)
    cuts = list(range(first, size, block))
    blocks = spark.createDataFrame([(i, a, min(a + block, size)) for i, a in enumerate(cuts)], "block long, a long, b long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = open_path(path)
        with system.open_input_file(name) as source:
            for batch in batches:
                for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    held: list[str] = []
                    number = chars = 0
                    for line in _lines_of(source, a, b, first):
                        held.append(line)
                        chars += len(line)
                        if len(held) == 2000 or chars > 4 << 20:
                            yield _batch(i, number, held)
                            number, chars = number + len(held), 0
                            held.clear()
                    if held:
                        yield _batch(i, number, held)

    def _batch(block: int, number: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(held, pa.string())], ["block", "_n", "value"]
        )

    dealt = blocks.repartition(max(1, len(cuts)), "block") if len(cuts) > 1 else blocks.coalesce(1)
    where = fresh_dir(spark, "tail")
    dealt.mapInArrow(read, "block long, _n long, value string").write.parquet(where)
    lines = spark.read.schema("block long, _n long, value string").parquet(where)
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("block").agg(F.count(F.lit(1)).alias("_k"))
    starts = starts.select("block", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_before"))
    placed = lines.join(starts, "block").select((F.lit(since.lines) + F.col("_before") + F.col("_n")).alias("row_idx"), "value")
    return placed, size


def append_lines(spark: SparkSession, lines: DataFrame, order: list[str], path: str) -> int | None:
    """Add ``value`` of ``lines`` at the end of the file ``path``, a line each in ``order``; returns the parts written.

    Many tasks write: rows are dealt by range of ``order`` and numbered within their part, each
    part's bytes are summed, and a task writes its parts where the parts before them end. Lines end
    with LF, as Spark's text writer ends them. None, with nothing written, where tasks cannot write
    into the file by its name.
    """
    try:
        system, name = open_path(path)
    except (ValueError, OSError, pa.ArrowException):
        return None
    if not isinstance(system, fs.LocalFileSystem):
        return None
    with open(name, "ab") as file:
        end = file.tell()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[int] = []
        held: list[bytes] = []
        held_at = at = 0
        handle = os.open(name, os.O_WRONLY)
        try:
            for batch in batches:
                for part, start, value in zip(*(batch.column(c).to_pylist() for c in ("_part", "_at", "value"))):
                    if not parts or part != parts[-1]:
                        if held:
                            os.pwrite(handle, b"".join(held), held_at)
                        parts.append(part)
                        held, held_at, at = [], start, start
                    held += (value, b"\n")
                    at += len(value) + 1
                if held:
                    os.pwrite(handle, b"".join(held), held_at)
                    held, held_at = [], at
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64())], ["part"])

    with scratch(spark):  # the staged lines are of no use once they are in the file
        where = fresh_dir(spark, "append")
        lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
            F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"),
            F.coalesce(F.col("value"), F.lit("")).cast("binary").alias("value"),
        ).write.parquet(where)
        stored = spark.read.schema("_part int, _seq long, value binary").parquet(where)
        sizes = stored.groupBy("_part").agg(F.sum(F.octet_length("value") + 1).alias("_n"))
        upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_part", (F.lit(end) + F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_at"))
        placed = stored.join(F.broadcast(starts), "_part").repartition("_part").sortWithinPartitions("_part", "_seq")
        return placed.mapInArrow(write, "part long").count()
