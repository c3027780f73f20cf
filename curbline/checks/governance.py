"""Guard and policy queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from ..plans import tables as T
from ..plans.tables import sql
from .collect import collection
from .text import mask_sql, strip_sql

query, QUERIES, SQL = collection()


@query(sql(rf"""
SELECT id, {mask_sql("complaint_type || CASE WHEN descriptor IS NULL THEN '' ELSE ': ' || " + strip_sql("regexp_replace(descriptor, '[: ]+$', '')") + " END")}
         AS text,
       floor(latitude * 100) / 100 AS coarse_latitude,
       floor(longitude * 100) / 100 AS coarse_longitude, created_date
FROM tickets""", T.TICKETS_SQL))
def prediction_inputs(spark, sf_dir):
    return G.require_no_leakage(G.inference_view(T.tickets(spark, sf_dir)))


LEAK_SQL = """
long AS (
  SELECT truth, 'k' AS field, CAST(k AS VARCHAR) AS value FROM scored UNION ALL
  SELECT truth, 'tier', tier FROM scored UNION ALL
  SELECT truth, 'pred', pred FROM scored
), cells AS (SELECT field, value, truth, count(*) AS n FROM long GROUP BY 1, 2, 3),
best AS (SELECT field, value, max(n) AS best, sum(n) AS n FROM cells GROUP BY 1, 2)"""


@query(sql("""
SELECT field, count(*) AS n_distinct, round(sum(best) / sum(n), 6) AS determines
FROM best GROUP BY field""", T.SCORED_SQL, LEAK_SQL))
def leakage_strength(spark, sf_dir):
    rows = G.leakage_audit(T.scored(spark, sf_dir), "truth", ["k", "tier", "pred"])
    return rows.withColumn("determines", F.round("determines", 6))


DRAFTS_SQL = """
d AS (
  SELECT CAST(event_id AS VARCHAR) AS ticket_id, pred AS routed,
         CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'DEP' ELSE pred END AS owner,
         CASE WHEN k % 11 = 0 THEN '' ELSE 'go' END AS next_action,
         CASE WHEN k % 3 = 0 THEN 'p' || (k % 4) END AS cited,
         'p' || (event_id % 4) AS known
  FROM scored)"""


@query(sql("""
SELECT ticket_id, concat_ws('; ',
         CASE WHEN coalesce(owner, '') = '' THEN 'owner missing' END,
         CASE WHEN next_action = '' THEN 'next_action missing' END,
         CASE WHEN coalesce(owner, '') <> '' AND owner IS DISTINCT FROM routed
              THEN 'owner not routed agency' END,
         CASE WHEN cited IS NOT NULL AND cited <> known AND cited <> 'p0'
              THEN 'precedent not in bundle' END) AS errors
FROM d""", T.SCORED_SQL, DRAFTS_SQL))
def draft_checks(spark, sf_dir):
    rows = T.scored(spark, sf_dir).withColumn("ticket_id", F.col("event_id").cast("string"))
    drafts = rows.select(
        "ticket_id",
        F.struct(
            F.when(F.col("k") % 7 == 0, None)
            .when(F.col("k") % 5 == 0, "DEP")
            .otherwise(F.col("pred"))
            .alias("owner"),
            F.when(F.col("k") % 11 == 0, "").otherwise("go").alias("next_action"),
            F.lit(None).cast("string").alias("due_date"),
            F.when(F.col("k") % 3 == 0, F.concat(F.lit("p"), F.col("k") % 4)).alias(
                "cited_precedent_id"
            ),
        ).alias("draft"),
    )
    decisions = rows.select("ticket_id", F.col("pred").alias("predicted_agency"))
    bundles = rows.select(
        "ticket_id",
        F.explode(
            F.array(F.concat(F.lit("p"), F.col("event_id") % 4), F.lit("p0"))
        ).alias("precedent_id"),
    )
    out = G.validate_drafts(drafts, decisions, bundles)
    return out.select("ticket_id", F.array_join("errors", "; ").alias("errors"))


@query(sql("""
SELECT md5(CAST(user_id * 100 + k AS VARCHAR)) AS draft_hash, min(event_id) AS id
FROM scored
WHERE k % 4 = 0 AND md5(CAST(user_id * 100 + k AS VARCHAR)) NOT IN
      (SELECT md5(CAST(user_id * 100 + k AS VARCHAR)) FROM scored WHERE event_id % 9 = 0)
GROUP BY 1""", T.SCORED_SQL))
def submission_set(spark, sf_dir):
    orders = T.scored(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.md5((F.col("user_id") * 100 + F.col("k")).cast("string")).alias("draft_hash"),
        F.when(F.col("k") % 4 == 0, "approved").otherwise("pending").alias("review_status"),
    )
    done = orders.filter("id % 9 = 0").select("draft_hash")
    return G.to_submit(orders, done).select("draft_hash", "id")


POLICY = {
    "tracker": {"id": "exact", "descriptor": "masked", "latitude": "coarse", "longitude": "coarse"},
    "local": {"id": "exact", "descriptor": "exact", "latitude": "exact", "longitude": "exact"},
}


@query(sql(f"""
SELECT id, {mask_sql('descriptor')} AS descriptor, floor(latitude * 100) / 100 AS latitude,
       floor(longitude * 100) / 100 AS longitude
FROM tickets""", T.TICKETS_SQL))
def destination_fields(spark, sf_dir):
    return G.apply_field_policy(T.tickets(spark, sf_dir), POLICY, "tracker")


PROPOSALS_SQL = """
proposals AS (
  SELECT CAST(event_id AS VARCHAR) AS ticket_id, CASE k % 6
    WHEN 0 THEN ['DEP', 'DOB'] WHEN 1 THEN ['DEP', 'DOT', 'HPD'] WHEN 2 THEN ['DEP']
    WHEN 3 THEN ['DEP', 'DOT', 'HPD', 'DOB'] WHEN 4 THEN ['DEP', 'FBI'] ELSE ['DEP', 'DEP'] END
    AS agencies, k FROM scored
)"""


def _proposals(spark, sf_dir):
    options = F.expr("""CASE k % 6 WHEN 0 THEN array('DEP', 'DOB') WHEN 1 THEN array('DEP', 'DOT', 'HPD')
        WHEN 2 THEN array('DEP') WHEN 3 THEN array('DEP', 'DOT', 'HPD', 'DOB')
        WHEN 4 THEN array('DEP', 'FBI') ELSE array('DEP', 'DEP') END""")
    return T.scored(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("ticket_id"), options.alias("agencies")
    )


@query(sql("""
SELECT ticket_id || '-' || i AS child_id, ticket_id, agencies[i] AS agency
FROM (SELECT ticket_id, agencies, unnest(range(1, len(agencies) + 1)) AS i FROM proposals
      WHERE k % 6 < 2)""", T.SCORED_SQL, PROPOSALS_SQL))
def split_children(spark, sf_dir):
    return G.expand_splits(_proposals(spark, sf_dir))[0].select("child_id", "ticket_id", "agency")


@query(sql("""
SELECT CASE k % 6 WHEN 2 THEN 'too few' WHEN 3 THEN 'over cap' WHEN 4 THEN 'unknown agency'
            ELSE 'repeated agency' END AS reason, count(*) AS n
FROM proposals WHERE k % 6 > 1 GROUP BY 1""", T.SCORED_SQL, PROPOSALS_SQL))
def split_rejections(spark, sf_dir):
    bad = G.expand_splits(_proposals(spark, sf_dir))[1]
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(sql("""
SELECT event_id, ts, path FROM scored
WHERE ts >= TIMESTAMP '2024-02-10' - INTERVAL 30 DAYS
  AND (path = 'agent'
       OR CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) < 429496730)""", T.SCORED_SQL))
def trace_retention(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select("event_id", "ts", "path")
    return G.retain(rows, "ts", "event_id", F.lit("2024-02-10").cast("timestamp_ntz"), days=30)


@query(sql("""
SELECT event_id, p.days IS NULL AS human_input_required,
       CAST(CAST(CAST(ts AS DATE) + p.days AS DATE) AS VARCHAR) AS due_date
FROM scored s LEFT JOIN (VALUES ('DEP', 'click', 3), ('DEP', 'view', 5), ('DOT', 'click', 7),
                                ('NYPD', 'error', 1)) p(owner, complaint_type, days)
  ON p.owner = s.truth AND p.complaint_type = s.event_type""", T.SCORED_SQL))
def policy_due_dates(spark, sf_dir):
    policy = spark.createDataFrame(
        [("DEP", "click", 3), ("DEP", "view", 5), ("DOT", "click", 7), ("NYPD", "error", 1)],
        "owner string, complaint_type string, days int",
    )
    rows = T.scored(spark, sf_dir).select(
        "event_id",
        F.col("truth").alias("owner"),
        F.col("event_type").alias("complaint_type"),
        F.col("ts").alias("created_date"),
    )
    return G.due_dates(rows, policy).select(
        "event_id", "human_input_required", F.col("due_date").cast("string").alias("due_date")
    )
