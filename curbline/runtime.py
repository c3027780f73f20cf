"""Session settings and reliable materialisation.

Loops and range layouts need their lineage cut. They do so only with
``checkpoint()`` into the shared folder that the cluster names in
``spark.checkpoint.dir``; executor-local storage is never relied on.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "curbline", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read; on a local master a temporary one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not named and not current:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="curbline-"))
    elif named and not current:
        spark.sparkContext.setCheckpointDir(named)
    return named or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for tables a job writes for itself."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    if not _scratch:
        atexit.register(_release_at_exit)
    _scratch.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the scratch tables of this process; results that read them end here.

    Happens by itself when the driver ends with its session still open.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count


def _release_at_exit() -> None:
    session = SparkSession.getActiveSession()
    if session is not None and session.sparkContext._jsc is not None:
        release(session)


def settle(df: DataFrame) -> DataFrame:
    """Materialise reliably and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For loops: unlike a checkpointed frame, the result carries none of the
    constraints of the plan it came from, so plans do not grow with the rounds. ``by`` names a
    column whose values get folders of their own.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, name: str, sql_type: str, make, drop: str | tuple = ()) -> DataFrame:
    """``df`` with one more column, which ``make`` computes from Arrow batches; ``drop`` goes."""
    import pyarrow as pa

    gone = (drop,) if isinstance(drop, str) else drop
    kept = [c for c in df.columns if c not in gone]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), make(batch)], names=[*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    return df.mapInArrow(run, f"{schema}, `{name}` {sql_type}")


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that lies in fewer splits than there are cores.

    For CPU-heavy row work on few, large row groups; a table with enough splits
    is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
