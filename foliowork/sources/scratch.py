"""Folders that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_own_roots: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where one machine does all, as in tests, it may be unset; else that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own_roots:
            _own_roots[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='foliowork-')}"
        root = _own_roots[context.applicationId]
    return f"{root.rstrip('/')}/foliowork/{name}-{uuid.uuid4().hex}"
