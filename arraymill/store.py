"""The folder that all executors share, for results that two plans must read alike."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def fixed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the session's checkpoint folder.

    The folder is the one in spark.checkpoint.dir; where the session names none,
    a local master (tests) gets a local one, and others fail.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="arraymill-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()
