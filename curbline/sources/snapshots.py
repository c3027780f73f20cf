"""Published tables: complete versions in folders of their own, and a pointer that is swapped.

A writer puts a whole version beside the others and then renames a small file over the
pointer, which the file system does at once. A reader follows the pointer when it opens the
table and from then on reads that version's files only, so it never sees parts of two versions. Old
versions go when they are past their age, except the one the pointer names.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import write_snapshot

POINTER = "CURRENT"
VERSION = re.compile(r"v=(\d{13})-[0-9a-f]{32}")


def _hadoop(spark: SparkSession, path: str):
    """(FileContext, Path class) for ``path``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    return fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf), jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, root: str, ts: str | None = None, at: float | None = None) -> str:
    """Write ``df`` as a new version below ``root`` and make it the current one; returns its name."""
    spark = df.sparkSession
    version = f"v={int((time.time() if at is None else at) * 1000):013d}-{uuid.uuid4().hex}"
    write_snapshot(df, f"{root}/{version}", ts)
    point(spark, root, version)
    return version


def point(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` the current one, in one rename."""
    fs, context, path = _hadoop(spark, root)
    if not VERSION.fullmatch(version) or not fs.exists(path(f"{root}/{version}/_SUCCESS")):
        raise ValueError(f"not a complete version: {version}")
    fresh = path(f"{root}/_{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, path(f"{root}/{POINTER}"), options)


def current(spark: SparkSession, root: str) -> str:
    """The name of the version that the pointer names just now."""
    fs, _, path = _hadoop(spark, root)
    file = fs.open(path(f"{root}/{POINTER}"))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    file.close()
    return text


def exists(spark: SparkSession, root: str) -> bool:
    """Whether anything has been published below ``root``."""
    fs, _, path = _hadoop(spark, root)
    return fs.exists(path(f"{root}/{POINTER}"))


def versions(spark: SparkSession, root: str) -> list[str]:
    """All complete versions, the oldest first."""
    fs, _, path = _hadoop(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory()]
    return sorted(v for v in found if VERSION.fullmatch(v) and fs.exists(path(f"{root}/{v}/_SUCCESS")))


def open_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The table of a version, the current one if none is named; pinned for the life of the frame."""
    return spark.read.parquet(f"{root}/{version or current(spark, root)}")


def expire(spark: SparkSession, root: str, older_than: float, now: float | None = None) -> list[str]:
    """Delete versions older than so many seconds, never the current one; returns what went."""
    fs, _, path = _hadoop(spark, root)
    limit, kept, gone = ((time.time() if now is None else now) - older_than) * 1000, current(spark, root), []
    for version in versions(spark, root):
        if version != kept and int(VERSION.fullmatch(version)[1]) < limit:
            fs.delete(path(f"{root}/{version}"), True)
            gone.append(version)
    return gone
