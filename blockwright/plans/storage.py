"""Places for tables that queries write between their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; where that is unset, in one of our own.

    The latter is for a single machine only (``local`` masters, as in tests): elsewhere no other machine would see it.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
