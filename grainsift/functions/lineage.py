"""Lineage cuts by reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to it that the session has a checkpoint folder: the one it has, or that
    of ``spark.checkpoint.dir``. One of its own is made only where all executors run
    on this machine (as in tests); a cluster has to name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="grainsift-ck-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """``df`` read from a checkpoint: what it took to make it isn't done again, not
    even if an executor is lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
