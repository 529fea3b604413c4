"""Tables written to the cluster's shared folder, to cut lineage and free shuffle files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes in an Arrow batch, so that long texts don't fill a worker's or an executor's buffers.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
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


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one call of an operator.

    ``write`` runs the plan, stores its rows as Parquet and returns a scan of them: what follows
    neither repeats the work nor depends on shuffle files of lost executors. ``drop`` deletes
    tables that no result needs; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0
        spark.conf.set(_BATCH, str(BATCH_BYTES))
        atexit.register(self._end)

    def write(self, df: DataFrame) -> DataFrame:
        path, self.written = f"{self.base}/t{self.written}", self.written + 1
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._evalgrid_scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            drop_path(self.spark, table._evalgrid_scratch)

    def _end(self) -> None:
        try:
            drop_path(self.spark, self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit; nothing is left to do then
            return
