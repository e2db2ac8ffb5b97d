"""Paths for files that live as long as a query, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to, under ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark
    runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidemark-scratch-"))
    return f"{shared.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
