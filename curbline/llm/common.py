"""Helpers that several operators share: tables, word patterns, files every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; every executor has it installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def opened(uri: str):
    """(filesystem, path) of a URI or an absolute path; works on executors for shared stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, made on the driver."""
    uri = scratch_path(spark, label)
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)
    return uri


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def attempt_name(stem: str, ending: str) -> str:
    """A file name no other attempt of the same task can use."""
    return f"{stem}-{uuid.uuid4().hex}{ending}"


def token_pattern() -> str:
    """The pattern that splits text before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, with the shuffle files behind it released.

    The tables hold texts, so they are packed by zstandard. Spark drops shuffle files once the driver has collected their plan as garbage; asking
    for that after each step keeps the disk use that of one step, not of all.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_hashes(df: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows with the smallest hash of ``key``: a bounded sample that any layout gives.

    On large tables a threshold that a few times ``size`` rows pass comes first, so tasks
    do not each hand on ``size`` rows.
    """
    n = df.count()
    place = F.xxhash64(key)
    if n > 16 * size:
        passed = df.where(place < -(1 << 63) + int((1 << 64) * (4 * size / n)))
        if passed.count() >= size:
            df = passed
    return df.orderBy(place, key).limit(size)
