"""A corpus kept as versions that share what they have in common.

Notes lie in buckets by a hash of their path. A version is a manifest: for each
bucket the folder that holds it. A change reads and writes the buckets it touches
and a new manifest; all other buckets are taken over. Nothing is ever changed
in place, so earlier versions stay readable until their folders are removed.

    location/manifest/version=3/   bucket, folder
    location/data/<id>/bucket=17/  the notes of one bucket, written by one version
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256  # choose so many that a bucket is some hundred megabytes

_MANIFEST = "bucket int, folder string, buckets int"


def create(notes: DataFrame, location: str, buckets: int = BUCKETS) -> int:
    """Write ``notes`` (path and other columns) as version 0. A corpus that is there is not overwritten."""
    spark = notes.sparkSession
    if versions(spark, location):
        raise FileExistsError(f"there is a corpus in {location}")
    return _commit(spark, location, 0, _written(notes, location, buckets), buckets)


def versions(spark: SparkSession, location: str) -> list[int]:
    """The numbers of the versions that were written to the end."""
    filesystem, root = _path(spark, f"{location}/manifest")
    if not filesystem.exists(root):
        return []
    found = []
    for status in filesystem.listStatus(root):
        done = _path(spark, f"{status.getPath().toString()}/_SUCCESS")[1]
        if filesystem.exists(done):
            found.append(int(status.getPath().getName().removeprefix("version=")))
    return sorted(found)


def read(spark: SparkSession, location: str, version: int | None = None) -> DataFrame:
    """The notes of a version, by default the latest."""
    manifest = _manifest(spark, location, version)
    return _folders(spark, location, {row["folder"] for row in manifest})


def change(spark: SparkSession, location: str, changes: DataFrame) -> int:
    """Write a new version with ``changes`` (path, new_path, content); returns its number.

    A null ``content`` keeps the note's text, a null ``new_path`` removes the note. Paths that
    the corpus does not have are passed over. Only buckets with a changed note, and those
    that moved notes go to, are read and written. Without changes nothing is written.
    """
    manifest = _manifest(spark, location, None)
    buckets = manifest[0]["buckets"]
    changes = changes.select("path", "new_path", "content")
    # At most one number a bucket comes back.
    touched = {
        row["bucket"]
        for row in changes.select(F.explode(F.array("path", "new_path")).alias("path"))
        .filter("path IS NOT NULL")
        .select(_bucket(F.col("path"), buckets))
        .distinct()
        .collect()
    }
    latest = versions(spark, location)[-1]
    if not touched:
        return latest
    kept = {row["bucket"]: row["folder"] for row in manifest if row["bucket"] not in touched}
    open_ = {row["folder"] for row in manifest if row["bucket"] in touched}
    if not open_:
        return latest
    old = _folders(spark, location, open_)
    named = changes.select("path", F.col("new_path").alias("_path"), F.col("content").alias("_content"), F.lit(True).alias("_hit"))
    columns = {
        "path": F.when(F.col("_hit"), F.col("_path")).otherwise(F.col("path")),
        "content": F.coalesce("_content", "content"),
    }
    new = old.join(named, "path", "left").select(*(columns.get(c, F.col(c)).alias(c) for c in old.columns))
    folders = _written(new.filter("path IS NOT NULL"), location, buckets)
    return _commit(spark, location, latest + 1, kept | folders, buckets)


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int").alias("bucket")


def _written(notes: DataFrame, location: str, buckets: int) -> dict[int, str]:
    """Write the notes by bucket; the folder of each bucket that has any."""
    spark = notes.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    placed = notes.withColumn("bucket", _bucket(F.col("path"), buckets))
    placed.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{location}/{folder}")
    filesystem, root = _path(spark, f"{location}/{folder}")
    names = (status.getPath().getName() for status in filesystem.listStatus(root))
    return {int(n.removeprefix("bucket=")): f"{folder}/{n}" for n in names if n.startswith("bucket=")}


def _commit(spark: SparkSession, location: str, version: int, folders: dict[int, str], buckets: int) -> int:
    # Fails if another writer has made this version meanwhile.
    rows = spark.createDataFrame([(b, f, buckets) for b, f in sorted(folders.items())] or [(None, None, buckets)], _MANIFEST)
    rows.coalesce(1).write.mode("error").parquet(f"{location}/manifest/version={version}")
    return version


def _manifest(spark: SparkSession, location: str, version: int | None) -> list:
    known = versions(spark, location)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no such version in {location}: {version}")
    chosen = known[-1] if version is None else version
    return spark.read.schema(_MANIFEST).parquet(f"{location}/manifest/version={chosen}").collect()


def _folders(spark: SparkSession, location: str, folders: set[str | None]) -> DataFrame:
    held = sorted(f"{location}/{folder}" for folder in folders if folder)
    if held:
        return spark.read.parquet(*held)
    # No file tells the columns of a corpus without notes.
    return spark.createDataFrame([], "path string, content string")


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
