"""Shared scratch space: where lineage is cut and files are written so that every executor sees them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where that is unset, a folder of our own if all runs in one
    process, as in tests; else an error, for a machine's own folder is not seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="slotloom-")
        _OWN[app] = where
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later steps never recompute it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has at most one row a key, where keys of ``many`` may be hot. counts: key
    and n, its rows in ``many``; total: rows of ``many``. Keys with over total / ``parts`` rows, of which there are fewer
    than ``parts``, are broadcast, so no task gets all rows of one; the rest are shuffled."""
    hot = F.broadcast(one.join(F.broadcast(counts.where(F.col("n") > total / parts).select(key)), key, "left_semi").withColumn("__hot", F.lit(True)))
    tried = many.join(hot, key, "left")
    rest = [c for c in one.columns if c != key]
    met = tried.where("__hot").drop("__hot")
    cold = tried.where("__hot IS NULL").drop("__hot", *rest).join(one, key)
    return met.unionByName(cold)


def uri_filesystem(uri: str):
    """(pyarrow filesystem, path) of a shared URI, for tasks that write files that are not Spark tables."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)
