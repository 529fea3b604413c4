"""Intermediate tables in the shared folder, and small files through Hadoop's file systems."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="evalgrid-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; nothing is left to do then
        return


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` written once and read back: later jobs neither repeat its work nor see other rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file(spark, path)
    files.delete(target, True)


def move_single_part(spark: SparkSession, folder: str, path: str) -> None:
    """The one part file of a written folder becomes ``path``, whatever was there; the folder goes."""
    files, source = _file(spark, folder)
    _, target = _file(spark, path)
    parts = [f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} part files in {folder}")
    files.delete(target, False)
    if not files.rename(parts[0], target):
        raise OSError(f"could not move {parts[0]} to {path}")
    files.delete(source, True)


def write_text(spark: SparkSession, path: str, text: str | bytes) -> str:
    """A small file on the path's own file system; folders are made."""
    files, target = _file(spark, path)
    out = files.create(target, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()
    return path
