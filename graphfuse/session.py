"""What the engine asks of its Spark session."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the session's shared folder.

    The folder is spark.checkpoint.dir.  Where that is unset and driver and executors
    are one process, a temporary one is set; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(told or "file://" + tempfile.mkdtemp(prefix="graphfuse-checkpoint-"))
    return df.checkpoint()
