"""Cutting a plan where what it made is read several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A path for files that all machines read; nothing uses it yet."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(root or tempfile.mkdtemp(prefix='episodica-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the cluster's shared checkpoint folder, which outlives any executor.

    The files go when the result is no longer referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    Without ``spark.checkpoint.dir`` a fresh local folder serves a local master; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="episodica-"))
    return df.checkpoint()
