"""The given tables as tickets and scored decisions.

Each view has a SQL twin (a CTE body) for checking. Columns the tables do not
have are derived from those they have by plain arithmetic, row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import shuffle_width


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TICKET_COLUMNS = """
  e.event_id AS event_id, e.user_id AS user_id, e.value AS value,
  CAST(e.event_id AS STRING) AS id, CAST(e.event_id AS STRING) AS unique_key,
  CASE e.event_type WHEN 'click' THEN 'Water System' WHEN 'error' THEN 'Street Condition'
       WHEN 'view' THEN 'Noise - Residential' WHEN 'purchase' THEN 'Sewer'
       WHEN 'signup' THEN 'Plumbing' END AS complaint_type,
  CASE e.user_id % 4 WHEN 0 THEN 'BROOKLYN' WHEN 1 THEN 'QUEENS' WHEN 2 THEN 'BRONX'
       ELSE NULL END AS borough,
  CAST(40.60 AS DOUBLE) + (e.user_id % 50) * CAST(0.0005 AS DOUBLE) AS latitude,
  CAST(-74.00 AS DOUBLE) + (e.user_id % 37) * CAST(0.0005 AS DOUBLE) AS longitude,
  e.ts AS created_date
"""

AGENCY_OF_LABEL = """
  CASE m.label WHEN 0 THEN 'DEP' WHEN 1 THEN 'DOT' WHEN 2 THEN 'DPR' WHEN 3 THEN 'HPD'
       WHEN 4 THEN 'DOB' WHEN 5 THEN 'NYPD' WHEN 6 THEN 'DSNY' WHEN 7 THEN 'FBI'
       WHEN 8 THEN 'FBI' WHEN 9 THEN 'FBI' END
"""

# tickets: one row per event, with the text of the document of the same number.
TICKETS_SQL = f"""
tickets AS (
  SELECT {TICKET_COLUMNS}, d.text AS descriptor
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id
)"""

# embedded: the tickets that have a vector and a label.
EMBEDDED_SQL = f"""
embedded AS (
  SELECT {TICKET_COLUMNS}, d.text AS descriptor, {AGENCY_OF_LABEL} AS agency,
         m.embedding AS vector
  FROM events e JOIN embeddings m ON m.vec_id = e.event_id
                LEFT JOIN documents d ON d.doc_id = e.event_id
)"""


def _ticket_columns() -> list:
    return [F.expr(part) for part in _split(TICKET_COLUMNS)]


def _split(text: str) -> list[str]:
    """Column list at top-level commas; CASE and CAST contain none outside brackets."""
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def bare_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets without text: no join at all."""
    return table(spark, sf_dir, "events").alias("e").select(*_ticket_columns())


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Work on the texts follows the join: keep its partitions, which Spark would else merge by their bytes.
    n = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    e = table(spark, sf_dir, "events").repartition(n, "event_id").alias("e")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(n, "doc_id").alias("d")
    joined = e.join(d, F.col("d.doc_id") == F.col("e.event_id"), "left")
    return joined.select(*_ticket_columns(), F.col("d.text").alias("descriptor"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").alias("e")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").alias("d")
    m = table(spark, sf_dir, "embeddings").alias("m")
    joined = e.join(m, F.col("m.vec_id") == F.col("e.event_id")).join(
        d, F.col("d.doc_id") == F.col("e.event_id"), "left"
    )
    return joined.select(
        *_ticket_columns(),
        F.col("d.text").alias("descriptor"),
        F.expr(AGENCY_OF_LABEL).alias("agency"),
        F.col("m.embedding").alias("vector"),
    )


# scored: one decision per event. {k} is the engine's way to read the JSON field.
SCORED_BODY = """
  SELECT event_id, user_id, ts, value, event_type, k,
         k / CAST(100 AS DOUBLE) AS conf,
         ((event_id * 37 + user_id * 11) % 100) < k AS correct,
         ((event_id * 53 + user_id * 17) % 100) < 60 AS correct_b,
         CASE event_id % 7 WHEN 0 THEN 'DEP' WHEN 1 THEN 'DOT' WHEN 2 THEN 'DPR' WHEN 3 THEN 'HPD'
              WHEN 4 THEN 'DOB' WHEN 5 THEN 'NYPD' ELSE 'DSNY' END AS truth,
         CASE WHEN user_id % 29 = 0 THEN NULL
              ELSE CASE (event_id + CASE WHEN ((event_id * 37 + user_id * 11) % 100) < k
                                         THEN 0 ELSE 1 + user_id % 6 END) % 7
                   WHEN 0 THEN 'DEP' WHEN 1 THEN 'DOT' WHEN 2 THEN 'DPR' WHEN 3 THEN 'HPD'
                   WHEN 4 THEN 'DOB' WHEN 5 THEN 'NYPD' ELSE 'DSNY' END END AS pred,
         CASE user_id % 3 WHEN 0 THEN 'cheap-knn' WHEN 1 THEN 'prior' ELSE 'groq' END AS tier,
         CASE WHEN k >= 75 THEN 'fast' ELSE 'agent' END AS path,
         user_id % 13 = 0 AS error,
         user_id % 17 = 0 AS overridden,
         event_id % 3 AS retries
  FROM ({source})
"""
SCORED_SQL = "scored AS (" + SCORED_BODY.format(
    source="SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"
) + ")"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    with_k = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return spark.sql(SCORED_BODY.format(source="SELECT * FROM {rows}"), rows=with_k)


def sql(body: str, *ctes: str) -> str:
    """A statement over the given CTEs, in DuckDB's words; the last may be the body's own."""
    recursive = "RECURSIVE " if any("rounds(" in c for c in ctes) else ""
    text = f"WITH {recursive}{', '.join(ctes)} {body}" if ctes else body
    return text.replace("AS STRING)", "AS VARCHAR)")


def tickets_table(rows: DataFrame) -> DataFrame:
    """Lifecycle columns a fresh ticket has."""
    return rows.select(
        "*",
        F.lit(None).cast("timestamp_ntz").alias("closed_date"),
        F.lit(1).cast("bigint").alias("report_count"),
        F.lit(None).cast("string").alias("duplicate_of"),
        F.lit("INGESTED").alias("status"),
    )
