"""Results that are kept between the passes of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in for it in local mode; on a cluster no executor would find that again,
    so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="settled_"))
    return f"{context.getCheckpointDir()}/{name}_{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, with its lineage cut; a lost executor loses nothing."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()
