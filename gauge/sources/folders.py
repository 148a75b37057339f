"""Folders that all executors share: for tables that are written and read again, and for cut lineage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where such folders are when the session names none and this machine is all there is.
LOCAL = "/tmp/checkpoints/gauge"


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder, but only if this machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{LOCAL}"
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a checkpoint: what is read twice is then the same both times."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    system, at = file_system(spark, path)
    out = system.create(at, True)
    out.write(bytearray(content))
    out.close()


def stat(spark: SparkSession, path: str) -> dict | None:
    """Number, bytes and last modification of the files at a path, or None if there is nothing."""
    system, at = file_system(spark, path)
    if not system.exists(at):
        return None
    found, n, size, modified = system.listFiles(at, True), 0, 0, 0
    while found.hasNext():
        one = found.next()
        if one.getPath().getName()[:1] not in "_.":
            n, size, modified = n + 1, size + one.getLen(), max(modified, one.getModificationTime())
    return {"files": n, "bytes": size, "modified": modified}


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None if there is none or it is not whole."""
    system, at = file_system(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None
