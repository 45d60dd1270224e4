"""Shared scratch space: where lineage is cut so that lost executors cost no more than a step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a folder of our own if all runs in one process, as in
    tests; else an error, for a machine's own folder is not seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="slotloom-")
        _OWN[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def saved(df: DataFrame, name: str) -> str:
    """Writes ``df`` to a new folder in the shared one; its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    return df.sparkSession.read.schema(df.schema).parquet(saved(df, name))
