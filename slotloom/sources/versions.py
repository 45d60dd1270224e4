"""Published versions of a table of sources (A9, K9), kept as a manifest by source.

Below a path are ``parts`` (rows, each part written once), ``manifests`` (which part holds each source, its rows and hash)
and ``claims``: the file of a version's number names its manifest. A version is there when its claim is; a claim appears whole
or not at all and never replaces another one. A writer that finds its number taken reads the version that has come before
it and merges again, so nothing of either is lost: a source stays as it is where the writer brings the same or fewer rows of
it, or does not bring it. Only sources that changed are written; manifests that name over ``PARTS`` parts are written anew
as one. File systems need a rename that fails where the target is there (HDFS), or links (local folders).

A null source is a source like others. Parts and manifests of writers that gave up are never read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.sources.scratch import cut

PARTS = 64
PART = "__part"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _claims(spark: SparkSession, path: str) -> dict[int, str]:
    """The manifest of each number that is taken; empty where a claim was begun and not ended."""
    fs, at = _files(spark, f"{path}/claims")
    if not fs.exists(at):
        return {}
    read = lambda p: spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")
    found = [s.getPath() for s in fs.listStatus(at)]
    return {int(p.getName()): read(p) for p in found if p.getName().isdigit()}


def _claim(spark: SparkSession, path: str, version: int, manifest: str) -> bool:
    """Whether the number could be taken for the manifest (and a part that has the rows' columns)."""
    fs, folder = _files(spark, f"{path}/claims")
    fs.mkdirs(folder)
    _, draft = _files(spark, f"{path}/claims/draft-{uuid.uuid4().hex}")
    _, target = _files(spark, f"{path}/claims/{version}")
    out = fs.create(draft, False)
    out.writeBytes(manifest)
    out.close()
    if fs.getUri().getScheme() != "file":
        taken = fs.rename(draft, target)
    else:
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            taken = True
        except FileExistsError:
            taken = False
    fs.delete(draft, False)
    return taken


def published_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last version below ``path``; None without one."""
    return max((v for v, manifest in _claims(spark, path).items() if manifest), default=None)


def _manifest(spark: SparkSession, path: str, claim: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifests/{claim.split(':')[0]}")


def _rows(spark: SparkSession, path: str, claim: str, source: str) -> DataFrame:
    manifest = _manifest(spark, path, claim)
    # PARTS at most, and those of one version more; a version without rows has its writer's part, which is empty.
    parts = [r[0] for r in manifest.select(PART).distinct().collect()] or [claim.split(":")[1]]
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{path}/parts/{p}" for p in parts])
    named = manifest.select(F.col("source").alias("__source"), F.col(PART).alias("__of"))
    return rows.join(named, rows[source].eqNullSafe(named["__source"]) & (rows[PART] == named["__of"]), "left_semi").drop(PART)


def read_published(spark: SparkSession, path: str, version: int | None = None, source: str = "source") -> DataFrame:
    """The rows of the last version, or of the one given."""
    claims = _claims(spark, path)
    version = max((v for v, manifest in claims.items() if manifest), default=None) if version is None else version
    if version is None or not claims.get(version):
        raise ValueError(f"nothing is published below {path}")
    return _rows(spark, path, claims[version], source)


def lost_sources(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """Sources with fewer rows in the new version than in the old one."""
    count = lambda df, name: df.groupBy(source).agg(F.count("*").alias(name))
    return count(old, "before").join(count(new, "after"), source, "left").select(source, "before", F.coalesce("after", F.lit(0)).alias("after")).where("after < before")


def content_hash(df: DataFrame) -> Column:
    """Tells the rows of a group, in any order."""
    each = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes])
    return F.concat_ws(":", F.sum(each.cast("decimal(20,0)")).cast("string"), F.bit_xor(each).cast("string"))


def _summary(df: DataFrame, source: str, hashed: str | None) -> DataFrame:
    hash_ = F.max(F.col(hashed).cast("string")) if hashed else content_hash(df)
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), hash_.alias("hash"))


def _merge(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """The manifest of both: ours where it is new or has as many rows at least and another hash."""
    a, b = theirs.select(F.struct("*").alias("a")), ours.select(F.struct("*").alias("b"))
    both = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "full_outer")
    new = F.col("a").isNull() | (F.col("b").isNotNull() & (F.col("b.n") >= F.col("a.n")) & ~F.col("b.hash").eqNullSafe(F.col("a.hash")))
    return both.select(F.when(new, F.col("b")).otherwise(F.col("a")).alias("m")).select("m.*")


def _write(spark: SparkSession, path: str, kind: str, df: DataFrame) -> str:
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/{kind}/{name}")
    return name


def _changed(ours: DataFrame, base: DataFrame | None) -> DataFrame:
    """Of a writer's sources those that the version does not have yet and that lose no rows."""
    if base is None:
        return ours
    a, b = base.select(F.struct("*").alias("a")), ours.select(F.struct("*").alias("b"))
    met = b.join(a, F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return met.where(F.col("a").isNull() | ((F.col("b.n") >= F.col("a.n")) & ~F.col("b.hash").eqNullSafe(F.col("a.hash")))).select("b.*")


def _commit(df: DataFrame, path: str, source: str, hashed: str | None, whole: bool) -> str:
    spark = df.sparkSession
    claims = _claims(spark, path)
    last = max((v for v, m in claims.items() if m), default=None)
    base = _manifest(spark, path, claims[last]) if last is not None else None
    ours = cut(_summary(df, source, hashed), "sources")
    if whole and base is not None:
        now = ours.select(F.col("source").alias("s"), F.col("n").alias("now"))
        if not base.join(now, F.col("source").eqNullSafe(F.col("s")), "left").where(F.coalesce("now", F.lit(0)) < F.col("n")).isEmpty():
            return "deferred"
    fresh = _changed(ours, base)
    if not whole and fresh.isEmpty():
        return "unchanged"
    keys, name = fresh.select(F.col("source").alias("__source")), uuid.uuid4().hex
    df.join(keys, df[source].eqNullSafe(keys["__source"]), "left_semi").withColumn(PART, F.lit(name)).write.parquet(f"{path}/parts/{name}")
    mine, theirs = _manifest(spark, path, _write(spark, path, "manifests", fresh.withColumn(PART, F.lit(name)))), base
    while True:
        merged = mine if theirs is None else _merge(theirs, mine)
        claim = f"{_write(spark, path, 'manifests', merged)}:{name}"
        if _manifest(spark, path, claim).select(PART).distinct().count() > PARTS:
            claim = _compacted(spark, path, claim, source)
        number = max(claims, default=-1) + 1
        if _claim(spark, path, number, claim):
            return f"v{number}"
        # Another writer was first: what it has published is merged as well.
        claims = _claims(spark, path)
        last = max(v for v, m in claims.items() if m)
        theirs = _manifest(spark, path, claims[last])


def _compacted(spark: SparkSession, path: str, claim: str, source: str) -> str:
    name = uuid.uuid4().hex
    _rows(spark, path, claim, source).withColumn(PART, F.lit(name)).write.parquet(f"{path}/parts/{name}")
    return f"{_write(spark, path, 'manifests', _manifest(spark, path, claim).withColumn(PART, F.lit(name)))}:{name}"


def publish(df: DataFrame, path: str, source: str = "source") -> str:
    """Publishes a whole new version below ``path``, unless a source of the present one lost rows: then "deferred" and the
    old version stays. Sources that are equal in both are not written again."""
    return _commit(df, path, source, None, True)


def refresh(df: DataFrame, path: str, source: str = "source", hashed: str = "source_hash") -> str:
    """K9: brings the sources of ``df`` up to date: those with another hash and no fewer rows are written, all others stay.
    "unchanged" where there are none, so a batch that runs again adds nothing."""
    return _commit(df, path, source, hashed, False)
