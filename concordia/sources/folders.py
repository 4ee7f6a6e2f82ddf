"""Where intermediate files go: a fresh folder in the one that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """A fresh path in spark.checkpoint.dir; where that is unset, in a folder of this machine, for tests alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="concordia-")
    return f"{base.rstrip('/')}/concordia/{uuid.uuid4().hex}"
