"""Places that all executors share, for cutting lineage, and sessions whose batches for Python are small."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes in a batch for Python, so that a task's memory does not depend on how long texts are. One longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a staged table, as stored, that dense() leaves to a task on average, at least.
TASK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, a local one for masters of one machine (tests), and an error elsewhere."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="arraymill-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dense(df: DataFrame) -> DataFrame:
    """stage(df), read in partitions of TASK_BYTES or more on average, as a task and a file for each few rows cost more than the rows."""
    out = stage(df)
    rdd = out._jdf.queryExecution().analyzed().rdd()
    where, files = _files(df.sparkSession, rdd.getCheckpointFile().get())
    return out.coalesce(max(1, min(rdd.getNumPartitions(), files.getContentSummary(where).getLength() // TASK_BYTES)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends if drop() does not do so before."""
    top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _files(spark, top)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{top}/rows"


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch path that nothing reads any more."""
    where, files = _files(spark, path)
    files.delete(where.getParent(), True)


def _files(spark: SparkSession, path: str) -> tuple:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def bounded(df: DataFrame) -> DataFrame:
    """The same rows in a session of their own that sends batches of BATCH_BYTES to Python; the caller's session keeps its settings."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == str(BATCH_BYTES):
        return df
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_BATCH, str(BATCH_BYTES))
    view = f"rows_{uuid.uuid4().hex}"
    df.createGlobalTempView(view)  # all sessions of an application see it
    try:
        return own.table(f"global_temp.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)
