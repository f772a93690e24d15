"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime (non-static) settings that decide results.

    * timestamps are compared as UTC instants;
    * JSON objects with a repeated key keep the last value, as the JSON
      readers of the input producers do.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may do without: a temporary folder is made, remembered
    in the session and removed when the process ends. Elsewhere executors would
    write to disks that the others cannot read, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.callsieve.localWorkDir", None)
    if not named:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        folder = tempfile.mkdtemp(prefix="callsieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.conf.set("spark.callsieve.localWorkDir", named)
    return named.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


#: Folders named within each open :func:`scratch`, the innermost last.
_named: list[list[str]] = []


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused sub-folder of :func:`shared_dir`; within :func:`scratch` it lasts as long as that."""
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _named:
        _named[-1].append(path)
    return path


def publish_file(spark: SparkSession, folder: str, path: str) -> None:
    """Put the one file that a job wrote to ``folder`` in the place of ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    (part,) = [f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")]
    files.delete(target, False)
    files.rename(part, target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, in whatever store it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what :func:`fresh_dir` has named inside.

    For code that writes its result before it leaves: frames that were made inside
    may read those folders, so they are of no use afterwards.
    """
    _named.append([])
    try:
        yield
    finally:
        for path in _named.pop():
            remove_path(spark, path)


def local_session(cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("callsieve")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CALLSIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
