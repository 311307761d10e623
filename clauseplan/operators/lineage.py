"""Lineage cuts to shared storage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, one is made up in local mode alone: on a cluster a machine's own
    folder is out of executors' sight."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.match(r"local(\[|$)", context.master):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        if not folder:
            raise PlanError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, read from the session's checkpoint folder."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
