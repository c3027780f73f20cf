"""Files in and out: landed JSON, labelled pairs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .schemas import BROKEN, LABELLED_PAIR, LANDED_REQUEST, RAW_REQUEST


def read_landing(
    spark: SparkSession, path: str, max_records: int | None = None, fmt: str = "json"
) -> DataFrame:
    """Landed request records (JSON lines, CSV with header, or Parquet).

    Lines of text formats that do not parse come with NULL fields and their text in
    ``_corrupt_record``; ``quarantine`` reports them.
    """
    reader = spark.read.schema(RAW_REQUEST if fmt == "parquet" else LANDED_REQUEST)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.format(fmt).load(path)
    if max_records is None:
        return rows
    return rows.orderBy("created_date", "unique_key").limit(max_records)


def read_landing_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole payload text per record, for the immutable raw table."""
    return spark.read.text(path).select(
        F.get_json_object("value", "$.unique_key").alias("unique_key"),
        F.col("value").alias("payload"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled text pairs, one JSON object per line; blank lines are skipped.

    A line that does not parse, or lacks a text or the label, stops the job and is named.
    """
    rows = spark.read.schema(StructType([*LABELLED_PAIR.fields]).add(BROKEN, "string")).json(path)
    usable = F.col(BROKEN).isNull() & F.col("text_a").isNotNull() & F.col("text_b").isNotNull() & F.col("label").isNotNull()
    message = F.concat(F.lit("unusable pair: "), F.coalesce(BROKEN, F.to_json(F.struct("text_a", "text_b", "label"))))
    checked = F.when(usable, F.col("text_a")).otherwise(F.raise_error(message).cast("string"))
    return rows.withColumn("text_a", checked).drop(BROKEN)


def write_snapshot(df: DataFrame, path: str, ts: str | None = "created_date") -> None:
    """A complete table in a new directory, by month of ``ts`` where that is given.

    One shuffle per write keeps the files of a month few, and a month of any
    size is spread over as many tasks as its share needs.
    """
    if ts is None:
        df.write.mode("errorifexists").parquet(path)
        return
    month = F.date_format(ts, "yyyy-MM")
    (
        df.withColumn("created_month", month)
        .hint("rebalance", "created_month")
        .write.mode("errorifexists")
        .partitionBy("created_month")
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, months=None) -> DataFrame:
    """A snapshot, pruned to ``months`` ('yyyy-MM') if given."""
    df = spark.read.parquet(path)
    return df if months is None else df.filter(F.col("created_month").isin(*months))


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("errorifexists").json(path)
