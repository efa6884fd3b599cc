"""Lineage cuts of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Used only by sessions of one machine (``local[...]``) that name no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/strandline"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see; a cluster must name one in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that all executors see in spark.checkpoint.dir")
        named = LOCAL_CHECKPOINTS
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
