"""Landing, incremental load and idempotent upserts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.taxonomy import COMPLAINT_AGENCY
from ..sources.schemas import BROKEN, RAW_REQUEST, TICKET

# Fixed value: mean days per month of the trailing window.
DAYS_PER_MONTH = 30.4375


def ticket_id(unique_key):
    return F.substring(F.sha2(unique_key, 256), 1, 32)


def filter_requests(
    df: DataFrame,
    borough: str | None = None,
    complaint_types=None,
    start: datetime | None = None,
    end: datetime | None = None,
    ts: str = "created_date",
) -> DataFrame:
    """AND of the given conditions; the date range is half-open."""
    if borough:
        df = df.filter(F.upper("borough") == borough.upper())
    if complaint_types:
        df = df.filter(F.col("complaint_type").isin(*complaint_types))
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end))
    return df


# Number and time texts that count as such; what casts take beyond them is malformed.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TIME = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+([+-][0-9:]+|Z)?)?\s*$"


def _number(text):
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _time(text):
    return F.when(text.rlike(TIME), F.try_to_timestamp(text))


def normalize(raw: DataFrame, keep=()) -> DataFrame:
    """Typed ticket fields; text that does not parse becomes NULL (see ``malformed``).

    Columns in ``keep`` pass through.
    """
    return raw.select(
        ticket_id(F.col("unique_key").cast("string")).alias("id"),
        F.col("unique_key").cast("string").alias("unique_key"),
        "complaint_type",
        "descriptor",
        F.nullif(F.upper("borough"), F.lit("")).alias("borough"),
        _number(F.nullif("latitude", F.lit(""))).alias("latitude"),
        _number(F.nullif("longitude", F.lit(""))).alias("longitude"),
        _time(F.nullif("created_date", F.lit(""))).alias("created_date"),
        _time(F.nullif("closed_date", F.lit(""))).alias("closed_date"),
        *keep,
    )


def malformed(raw: DataFrame) -> DataFrame:
    """Raw rows with the reasons why they cannot be normalised (array, may be empty)."""

    def bad(column, parsed):
        given = F.nullif(F.col(column), F.lit(""))
        return F.when(given.isNotNull() & parsed(given).isNull(), F.lit(f"bad {column}"))

    checks = [F.when(F.col("unique_key").isNull(), F.lit("no unique_key"))]
    if BROKEN in raw.columns:
        checks = [
            F.when(F.col(BROKEN).isNotNull(), F.lit("unreadable")).when(
                F.col("unique_key").isNull(), F.lit("no unique_key")
            )
        ]
    checks += [bad(c, _number) for c in ("latitude", "longitude")]
    checks += [bad(c, _time) for c in ("created_date", "closed_date")]
    return raw.withColumn("reasons", F.array_compact(F.array(*checks)))


def watermark(tickets: DataFrame, ts: str = "created_date") -> DataFrame:
    return tickets.agg(F.max(ts).alias("watermark"))


def delta(landing: DataFrame, tickets: DataFrame, ts: str = "created_date") -> DataFrame:
    """Landing rows at or after the newest ticket; all rows while there is none.

    The newest time is read first, so that the scan gets a literal it can prune by.
    """
    newest = watermark(tickets, ts).select(F.col("watermark").cast("string")).first()[0]
    if newest is None:
        return landing
    return landing.filter(F.col(ts) >= F.lit(newest).cast(landing.schema[ts].dataType))


def backfill_window(months: int, now: datetime) -> tuple[datetime, datetime]:
    return now - timedelta(days=round(months * DAYS_PER_MONTH)), now


def backfill(
    landing: DataFrame,
    months: int = 12,
    now: datetime | None = None,
    borough: str | None = None,
    types=tuple(COMPLAINT_AGENCY),
    max_records: int | None = None,
    ts: str = "created_date",
) -> DataFrame:
    """Whitelisted types in the trailing window, oldest first if capped."""
    start, end = backfill_window(months, now or datetime.utcnow())
    rows = filter_requests(landing, borough, types, start, end, ts)
    return rows if max_records is None else rows.orderBy(ts, "unique_key").limit(max_records)


def _latest(df: DataFrame, key: str, order, pick) -> DataFrame:
    """One row per key by a map-side combining aggregate - no per-key window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(pick(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def land_raw(existing: DataFrame, incoming: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Keep the first payload per key; known keys are left as they are.

    Rows without a key are not landed: no later run could tell them from new ones. They
    are ``quarantine``'s to report.
    """
    incoming = incoming.filter(F.col("unique_key").isNotNull())
    first = _latest(incoming, "unique_key", F.col(order), F.min_by)
    fresh = first.join(existing.select("unique_key"), "unique_key", "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


NORMALISED = (
    "complaint_type",
    "descriptor",
    "borough",
    "latitude",
    "longitude",
    "created_date",
    "closed_date",
)


def upsert_tickets(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Take normalised fields from the last incoming row per key, keep lifecycle fields.

    Rows without a key are not taken; they are ``quarantine``'s to report.
    """
    incoming = incoming.filter(F.col("unique_key").isNotNull())
    last = _latest(incoming, "unique_key", F.col(order), F.max_by)
    new = last.select(
        "unique_key",
        F.lit(True).alias("_new"),
        F.col("id").alias("_id"),
        *[F.col(c).alias(f"_{c}") for c in NORMALISED],
    )
    joined = existing.join(new, "unique_key", "full_outer")
    fields = {
        c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in NORMALISED
    }
    kept = {
        "id": F.coalesce("id", "_id").alias("id"),
        "report_count": F.when(F.col("id").isNull(), 1)
        .otherwise(F.col("report_count"))
        .alias("report_count"),
        "status": F.when(F.col("id").isNull(), "INGESTED")
        .otherwise(F.col("status"))
        .alias("status"),
    }
    return joined.select(*[fields.get(c, kept.get(c, F.col(c))) for c in existing.columns])


def missing_vectors(
    tickets: DataFrame, vectors: DataFrame, key: str = "id", limit: int | None = None
) -> DataFrame:
    rows = tickets.join(vectors.select(F.col("ticket_id").alias(key)), key, "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def upsert_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace those of the same ticket; of several new ones the latest counts."""
    order = [c for c in ("created_at", "model", "vector") if c in new.columns]
    new = _latest(new, "ticket_id", F.struct(*order), F.max_by)
    kept = existing.join(new.select("ticket_id"), "ticket_id", "left_anti")
    return kept.unionByName(new.select(existing.columns))


def vectorize(df: DataFrame, fn, key: str, text: str, batch: int = 128) -> DataFrame:
    """Vectors from a user function ``list[str] -> list[list[float]]`` in fixed batches."""

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part[[key]].assign(vector=list(fn(part[text].fillna("").tolist())))

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def empty_tickets(spark) -> DataFrame:
    return spark.createDataFrame([], TICKET)


def empty_raw(spark) -> DataFrame:
    return spark.createDataFrame([], RAW_REQUEST)
