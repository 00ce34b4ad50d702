"""Where checkpoints and intermediate tables go: the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a single machine."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="rowmark-checkpoints-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new name for a folder beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/rowmark-{uuid.uuid4()}"
