"""Where queries that write keep what they wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, hint: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir), or a temporary one in local mode only."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scriven-")
    return f"{path.rstrip('/')}/{hint}-{uuid.uuid4().hex}"
