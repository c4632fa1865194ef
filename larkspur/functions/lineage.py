"""Cutting lineage in a place that every executor can read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where the session names none, a new temporary one if all of Spark
    runs in one process (tests); on a cluster that is an error, as a folder of one machine is lost with it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="larkspur-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows, read back from a reliable checkpoint; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
