"""Cutting lineage in iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in a reliable checkpoint, so that later rounds neither repeat nor plan it again.

    The folder is the session's ``spark.checkpoint.dir``; only a local session without one gets a local folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints", f"pixelmill-{uuid.uuid4().hex}"))
    return df.checkpoint()
