"""Ingest queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import landing as L
from ..operators.governance import quarantine
from ..operators.metrics import key_counts
from ..operators.ordering import first_n
from ..plans import tables as T
from ..plans.tables import sql
from ..runtime import scratch_path
from ..sources import files
from .collect import collection

query, QUERIES, SQL = collection()

CREATED_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def _raw(spark, sf_dir):
    """Tickets as the text records a source would send; every 11th has broken fields."""
    odd = F.col("event_id") % 11
    return T.bare_tickets(spark, sf_dir).select(
        "unique_key",
        F.when(odd == 1, "yesterday").when(odd == 2, "")
        .otherwise(F.date_format("created_date", CREATED_TEXT)).alias("created_date"),
        F.lit(None).cast("string").alias("closed_date"),
        "complaint_type",
        F.lit(None).cast("string").alias("descriptor"),
        F.lit(None).cast("string").alias("agency"),
        F.lower(F.coalesce("borough", F.lit(""))).alias("borough"),
        F.when(odd == 3, "north").when(odd == 4, "").otherwise(
            F.concat(F.lit("40."), (F.col("user_id") % 50).cast("string"))
        ).alias("latitude"),
        F.concat(F.lit("-73."), (F.col("user_id") % 37).cast("string")).alias("longitude"),
        F.lit("Open").alias("status"),
    )


RAW_SQL = """
raw AS (
  SELECT unique_key,
         CASE event_id % 11 WHEN 1 THEN 'yesterday' WHEN 2 THEN ''
              ELSE strftime(created_date, '%Y-%m-%dT%H:%M:%S.%g') END AS created_date,
         complaint_type, lower(coalesce(borough, '')) AS borough,
         CASE event_id % 11 WHEN 3 THEN 'north' WHEN 4 THEN ''
              ELSE '40.' || CAST(user_id % 50 AS VARCHAR) END AS latitude,
         '-73.' || CAST(user_id % 37 AS VARCHAR) AS longitude
  FROM tickets
)"""


def _landed(spark, sf_dir):
    path = scratch_path(spark, "landing")
    _raw(spark, sf_dir).write.json(path)
    return path


@query(sql("""
SELECT complaint_type, count(*) AS n, count(nullif(created_date, '')) AS dated,
       min(unique_key) AS first_key, max(unique_key) AS last_key, max(created_date) AS last_created
FROM raw GROUP BY complaint_type""", T.TICKETS_SQL, RAW_SQL))
def landing_scan(spark, sf_dir):
    rows = files.read_landing(spark, _landed(spark, sf_dir))
    return rows.groupBy("complaint_type").agg(
        F.count("*").alias("n"),
        F.count(F.nullif("created_date", F.lit(""))).alias("dated"),
        F.min("unique_key").alias("first_key"),
        F.max("unique_key").alias("last_key"),
        F.max("created_date").alias("last_created"),
    )


@query(sql("""
SELECT unique_key, created_date, borough FROM raw
ORDER BY created_date, unique_key LIMIT 100""", T.TICKETS_SQL, RAW_SQL))
def landing_cap(spark, sf_dir):
    rows = files.read_landing(spark, _landed(spark, sf_dir), max_records=100)
    return rows.select("unique_key", "created_date", "borough")


@query(sql("""
SELECT complaint_type, count(*) AS n, min(created_date) AS first_at, max(created_date) AS last_at
FROM tickets
WHERE upper(borough) = 'BROOKLYN' AND complaint_type IN ('Sewer', 'Plumbing')
  AND created_date >= TIMESTAMP '2024-01-05' AND created_date < TIMESTAMP '2024-01-20'
GROUP BY complaint_type""", T.TICKETS_SQL))
def request_filter(spark, sf_dir):
    rows = L.filter_requests(
        T.bare_tickets(spark, sf_dir),
        "brooklyn",
        ["Sewer", "Plumbing"],
        datetime(2024, 1, 5),
        datetime(2024, 1, 20),
    )
    return rows.groupBy("complaint_type").agg(
        F.count("*").alias("n"),
        F.min("created_date").alias("first_at"),
        F.max("created_date").alias("last_at"),
    )


@query(sql("SELECT max(created_date) AS watermark FROM tickets", T.TICKETS_SQL))
def delta_cursor(spark, sf_dir):
    return L.watermark(T.bare_tickets(spark, sf_dir))


@query(sql("""
SELECT unique_key, created_date FROM tickets
WHERE created_date >= (SELECT max(created_date) FROM tickets
                       WHERE created_date < TIMESTAMP '2024-01-20')""", T.TICKETS_SQL))
def incremental_pull(spark, sf_dir):
    rows = T.bare_tickets(spark, sf_dir)
    held = rows.filter(F.col("created_date") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return L.delta(rows, held).select("unique_key", "created_date")


@query(sql("""
SELECT complaint_type, count(*) AS n, min(created_date) AS first_at FROM tickets
WHERE upper(borough) = 'QUEENS'
  AND complaint_type IN ('Water System', 'Sewer', 'Street Condition', 'Street Light Condition',
      'Sidewalk Condition', 'Damaged Tree', 'Noise - Residential', 'HEAT/HOT WATER', 'Plumbing',
      'General Construction')
  AND created_date >= TIMESTAMP '2024-01-25' - INTERVAL 15 DAY
  AND created_date < TIMESTAMP '2024-01-25'
GROUP BY complaint_type""", T.TICKETS_SQL))
def backfill_window(spark, sf_dir):
    rows = L.backfill(
        T.bare_tickets(spark, sf_dir), months=0.5, now=datetime(2024, 1, 25), borough="QUEENS"
    )
    return rows.groupBy("complaint_type").agg(
        F.count("*").alias("n"), F.min("created_date").alias("first_at")
    )


RECORDS_SQL = """
records AS (
  SELECT CAST(user_id * 10 + event_id % 10 AS VARCHAR) AS unique_key, props AS payload,
         ts AS ingested_at, event_id, value, event_type
  FROM events
)"""


def _records(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).cast("string").alias("unique_key"),
        F.col("props").alias("payload"),
        F.col("ts").alias("ingested_at"),
        "event_id",
        "value",
        "event_type",
    )


CUT = "2024-01-03"


@query(sql(f"""
SELECT unique_key, arg_min(payload, ingested_at) AS payload, min(ingested_at) AS ingested_at
FROM records GROUP BY unique_key""", RECORDS_SQL))
def raw_first_write(spark, sf_dir):
    rows = _records(spark, sf_dir).select("unique_key", "payload", "ingested_at")
    cut = F.lit(CUT).cast("timestamp_ntz")
    none = rows.limit(0)
    held = L.land_raw(none, rows.filter(F.col("ingested_at") < cut))
    return L.land_raw(held, rows.filter(F.col("ingested_at") >= cut))


@query(sql(f"""
SELECT unique_key,
       CASE WHEN max(ingested_at) FILTER (ingested_at >= TIMESTAMP '{CUT}') IS NULL
            THEN 'kept' ELSE 'renewed' END AS touched,
       arg_max(event_type, ingested_at) AS complaint_type,
       arg_max(value, ingested_at) AS latitude,
       CASE WHEN min(ingested_at) < TIMESTAMP '{CUT}' THEN 'ROUTED' ELSE 'INGESTED' END AS status,
       CAST(CASE WHEN min(ingested_at) < TIMESTAMP '{CUT}' THEN 3 ELSE 1 END AS BIGINT)
         AS report_count
FROM records GROUP BY unique_key""", RECORDS_SQL))
def ticket_upsert(spark, sf_dir):
    cut = F.lit(CUT).cast("timestamp_ntz")
    rows = _records(spark, sf_dir).select(
        L.ticket_id(F.col("unique_key")).alias("id"),
        "unique_key",
        F.col("event_type").alias("complaint_type"),
        F.lit(None).cast("string").alias("descriptor"),
        F.lit(None).cast("string").alias("borough"),
        F.col("value").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.col("ingested_at").alias("created_date"),
        F.lit(None).cast("timestamp_ntz").alias("closed_date"),
    )
    blank = rows.limit(0).select(
        "*",
        F.lit(1).alias("report_count"),
        F.lit(None).cast("string").alias("duplicate_of"),
        F.lit("").alias("status"),
    )
    held = L.upsert_tickets(blank, rows.filter(F.col("created_date") < cut), "created_date")
    held = held.withColumn("status", F.lit("ROUTED")).withColumn("report_count", F.lit(3))
    after = L.upsert_tickets(held, rows.filter(F.col("created_date") >= cut), "created_date")
    return after.select(
        "unique_key",
        F.when(F.col("created_date") >= cut, "renewed").otherwise("kept").alias("touched"),
        "complaint_type",
        "latitude",
        "status",
        F.col("report_count").cast("bigint").alias("report_count"),
    )


@query("""
SELECT l.quality = 1 AS label, l.quality = 1 AS ann1, l.toxic = 0 AS ann2,
       count(*) AS n, CAST(sum(length(a.text)) AS BIGINT) AS chars_a,
       CAST(sum(length(b.text)) AS BIGINT) AS chars_b
FROM labels l JOIN documents a ON a.doc_id = l.doc_id JOIN documents b ON b.doc_id = l.doc_id + 1
GROUP BY 1, 2, 3""")
def labelled_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    rows = _pairs(spark, sf_dir).withColumn("line", F.to_json(F.struct("*")))
    rows.select(F.explode(F.array("line", F.lit("")))).write.text(path)
    pairs = files.read_pairs(spark, path)
    return pairs.groupBy("label", "ann1", "ann2").agg(
        F.count("*").alias("n"),
        F.sum(F.length("text_a")).alias("chars_a"),
        F.sum(F.length("text_b")).alias("chars_b"),
    )


def _pairs(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels")
    a = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_a"))
    b = T.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b")
    )
    return labels.join(a, "doc_id").join(b, "doc_id").select(
        "text_a",
        "text_b",
        (F.col("quality") == 1).alias("label"),
        (F.col("quality") == 1).alias("ann1"),
        (F.col("toxic") == 0).alias("ann2"),
    )


@query(sql("""
SELECT t.complaint_type, count(*) AS n, min(t.id) AS first_id
FROM tickets t LEFT JOIN embeddings m ON m.vec_id = t.event_id
WHERE m.vec_id IS NULL GROUP BY t.complaint_type""", T.TICKETS_SQL))
def missing_vectors(spark, sf_dir):
    vectors = T.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("ticket_id")
    )
    rows = L.missing_vectors(T.bare_tickets(spark, sf_dir), vectors)
    return rows.groupBy("complaint_type").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id")
    )


@query(sql("""
SELECT t.id FROM tickets t LEFT JOIN embeddings m ON m.vec_id = t.event_id
WHERE m.vec_id IS NULL ORDER BY t.id LIMIT 128""", T.TICKETS_SQL))
def embed_backlog(spark, sf_dir):
    vectors = T.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("ticket_id")
    )
    return L.missing_vectors(T.bare_tickets(spark, sf_dir), vectors, limit=128).select("id")


@query("""
SELECT vec_id AS ticket_id, CASE WHEN label % 2 = 0 THEN 'second' ELSE 'first' END AS model,
       round(CAST(CASE WHEN label % 2 = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6)
         AS x0
FROM embeddings""")
def vector_upsert(spark, sf_dir):
    m = T.table(spark, sf_dir, "embeddings")
    old = m.select(F.col("vec_id").alias("ticket_id"), F.col("embedding").alias("vector"),
                   F.lit("first").alias("model"))
    new = m.filter("label % 2 = 0").select(
        F.col("vec_id").alias("ticket_id"),
        F.transform("embedding", lambda x: -x).alias("vector"),
        F.lit("second").alias("model"),
    )
    rows = L.upsert_vectors(old, new)
    return rows.select(
        "ticket_id", "model", F.round(F.col("vector")[0].cast("double"), 6).alias("x0")
    )


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS created_month, count(*) AS n,
       round(sum(o_totalprice), 2) AS total
FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-03', '1996-07')
GROUP BY 1""")
def month_snapshot(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    files.write_snapshot(T.table(spark, sf_dir, "orders"), path, ts="o_orderdate")
    rows = files.read_snapshot(spark, path, ["1995-03", "1996-07"])
    return rows.groupBy(F.col("created_month").cast("string").alias("created_month")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(sql("""
SELECT substr(sha256(unique_key), 1, 32) AS id, unique_key, complaint_type,
       nullif(upper(borough), '') AS borough, TRY_CAST(nullif(latitude, '') AS DOUBLE) AS latitude,
       TRY_CAST(nullif(longitude, '') AS DOUBLE) AS longitude,
       TRY_CAST(nullif(created_date, '') AS TIMESTAMP) AS created_date
FROM raw""", T.TICKETS_SQL, RAW_SQL))
def normalize_payload(spark, sf_dir):
    rows = L.normalize(_raw(spark, sf_dir))
    return rows.select(
        "id", "unique_key", "complaint_type", "borough", "latitude", "longitude",
        F.col("created_date").cast("timestamp_ntz").alias("created_date"),
    )


JUDGED_SQL = """
judged AS (
  SELECT CASE WHEN TRY_CAST(nullif(latitude, '') AS DOUBLE) IS NULL AND latitude <> ''
              THEN 'bad latitude'
              WHEN TRY_CAST(nullif(created_date, '') AS TIMESTAMP) IS NULL AND created_date <> ''
              THEN 'bad created_date' ELSE 'good' END AS outcome
  FROM raw
)"""


@query(sql("SELECT outcome, count(*) AS n FROM judged GROUP BY outcome",
           T.TICKETS_SQL, RAW_SQL, JUDGED_SQL))
def quarantine_split(spark, sf_dir):
    good, bad = quarantine(_raw(spark, sf_dir))
    rows = good.select(F.lit("good").alias("outcome")).unionByName(
        bad.select(F.array_join("reasons", "+").alias("outcome"))
    )
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query(sql("SELECT unique_key, count(*) AS n FROM records GROUP BY unique_key", RECORDS_SQL))
def key_uniqueness(spark, sf_dir):
    return key_counts(_records(spark, sf_dir), "unique_key")


@query(sql("""
SELECT unique_key, created_date FROM tickets
ORDER BY created_date, unique_key LIMIT 250""", T.TICKETS_SQL))
def first_requests(spark, sf_dir):
    rows = first_n(T.bare_tickets(spark, sf_dir), ["created_date", "unique_key"], 250)
    return rows.select("unique_key", "created_date")
