"""Monitoring queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as O
from ..operators.calibration import rolling_ece
from ..operators.metrics import ratio
from ..plans import tables as T
from ..plans.tables import sql
from .collect import collection

query, QUERIES, SQL = collection()


def _round(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


MID = "2024-01-15"


@query(f"""
WITH c AS (
  SELECT event_type, count(*) FILTER (ts < TIMESTAMP '{MID}') AS ref,
         count(*) FILTER (NOT ts < TIMESTAMP '{MID}') AS cur FROM events GROUP BY 1
), s AS (
  SELECT (ref + 1.0) / (SELECT sum(ref) + count(*) FROM c) AS p,
         (cur + 1.0) / (SELECT sum(cur) + count(*) FROM c) AS q FROM c)
SELECT round(CAST(sum((q - p) * ln(q / p)) AS DOUBLE), 9) AS psi,
       round(CAST(sum(q * ln(q / p)) AS DOUBLE), 9) AS kl, count(*) AS categories FROM s""")
def mix_drift(spark, sf_dir):
    rows = O.psi(
        T.table(spark, sf_dir, "events"),
        F.col("ts") < F.lit(MID).cast("timestamp_ntz"),
        "event_type",
    )
    return _round(rows, "psi", "kl", digits=9)


@query("""
WITH x AS (SELECT label < 5 AS ref, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
           FROM embeddings),
m AS (SELECT ref, pos, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY 1, 2)
SELECT round(1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))), 6) AS shift
FROM m a JOIN m b ON a.pos = b.pos AND a.ref AND NOT b.ref""")
def vector_drift(spark, sf_dir):
    rows = O.centroid_shift(T.table(spark, sf_dir, "embeddings"), F.col("label") < 5, "embedding")
    return _round(rows, "shift")


DAILY_SQL = """
daily AS (
  SELECT CAST(ts AS DATE) AS d, least(floor(conf * 10), 9) AS bin, sum(conf) AS c,
         count(*) FILTER (correct) AS ok, count(*) AS n FROM scored GROUP BY 1, 2
), curve AS (
  SELECT x.day, d.bin, sum(d.c) / sum(d.n) AS m, sum(d.ok) / sum(d.n) AS a, sum(d.n) AS n
  FROM (SELECT DISTINCT d AS day FROM daily) x JOIN daily d ON d.d BETWEEN x.day - 6 AND x.day
  GROUP BY 1, 2
)"""


@query(sql("""
SELECT CAST(day AS VARCHAR) AS day, round(sum(n * abs(a - m)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n,
       sum(n * abs(a - m)) / sum(n) > 0.08 AS breach
FROM curve GROUP BY curve.day""", T.SCORED_SQL, DAILY_SQL))
def calibration_drift(spark, sf_dir):
    return _text_day(
        _round(rolling_ece(T.scored(spark, sf_dir), "ts", "conf", "correct"), "ece")
    )


TIER_DAYS_SQL = """
daily AS (
  SELECT CAST(ts AS DATE) AS day,
         round(coalesce(count(*) FILTER (tier LIKE 'cheap%' AND conf >= 0.7 AND NOT correct)
               / nullif(count(*) FILTER (tier LIKE 'cheap%' AND conf >= 0.7), 0), 0), 6) AS wrong,
         round(count(*) FILTER (path = 'agent') / count(*), 6) AS agent
  FROM scored GROUP BY 1)"""


@query(sql("""
SELECT CAST(day AS VARCHAR) AS day, wrong, agent, round(coalesce(wrong - lag(wrong) OVER (ORDER BY daily.day), 0), 6) AS wrong_change,
       round(coalesce(agent - lag(agent) OVER (ORDER BY daily.day), 0), 6) AS agent_change
FROM daily""", T.SCORED_SQL, TIER_DAYS_SQL))
def tier_drift(spark, sf_dir):
    hot = F.col("tier").startswith("cheap") & (F.col("conf") >= 0.7)
    rows = O.behaviour_drift(
        T.scored(spark, sf_dir),
        "ts",
        {
            "wrong": F.round(ratio(F.count_if(hot & ~F.col("correct")), F.count_if(hot)), 6),
            "agent": F.round(ratio(F.count_if(F.col("path") == "agent"), F.count("*")), 6),
        },
    )
    return _text_day(_round(rows.fillna(0.0), "wrong_change", "agent_change"))


@query("""
SELECT last_turn + 1 AS turns, count(*) AS cases, count(*) FILTER (gave_up) AS given_up
FROM (SELECT conv_id, max(turn) AS last_turn, bool_or(role = 'assistant' AND turn >= 5) AS gave_up
      FROM conversations GROUP BY conv_id) GROUP BY 1""")
def turn_histogram(spark, sf_dir):
    gave_up = (F.col("role") == "assistant") & (F.col("turn") >= 5)
    return O.turn_statistics(T.table(spark, sf_dir, "conversations"), "conv_id", "turn", gave_up)


@query("""
SELECT conv_id, coalesce(first_before, -1) AS first_before,
       coalesce(first_after, -1) AS first_after,
       first_after IS NOT NULL AND (first_before IS NULL OR first_before >= first_after) AS broken
FROM (SELECT conv_id, min(turn) FILTER (role = 'user') AS first_before,
             min(turn) FILTER (role = 'assistant') AS first_after
      FROM conversations GROUP BY conv_id)""")
def trace_order(spark, sf_dir):
    rows = O.trace_assertions(
        T.table(spark, sf_dir, "conversations"),
        "conv_id",
        "turn",
        F.col("role") == "user",
        F.col("role") == "assistant",
    )
    return rows.fillna(-1, ["first_before", "first_after"])


RANKED_SQL = """
ranked AS (
  SELECT *, CAST(ts AS DATE) AS day,
         row_number() OVER (PARTITION BY CAST(ts AS DATE), path ORDER BY value) AS r,
         count(*) OVER (PARTITION BY CAST(ts AS DATE), path) AS size FROM scored)"""


@query(sql("""
SELECT CAST(day AS VARCHAR) AS day, path, count(*) AS tickets, round(sum(value) / 1000, 6) AS cost,
       round(sum(value) / 1000 / count(*), 9) AS cost_per_ticket,
       round(sum(value) / 1000 / 5, 6) AS spend_share,
       round(count(*) FILTER (error) / count(*), 6) AS error_rate,
       round(sum(retries) / count(*), 6) AS retries_per_ticket,
       round(count(*) FILTER (overridden) / count(*), 6) AS override_rate,
       min(value) FILTER (r >= 0.95 * size) AS p95
FROM ranked GROUP BY ranked.day, path""", T.SCORED_SQL, RANKED_SQL))
def operations(spark, sf_dir):
    rows = T.scored(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn(
        "cost", F.col("value") / 1000
    )
    out = O.ops_metrics(rows, ["day", "path"], "value", "cost", 5.0)
    out = _round(out, "cost", "spend_share", "error_rate", "retries_per_ticket", "override_rate")
    return _text_day(_round(out, "cost_per_ticket", digits=9))


@query("""
WITH m AS (
  SELECT event_type AS metric, date_trunc('hour', ts) AS period, round(avg(value), 6) AS value
  FROM events GROUP BY 1, 2
), over_limit AS (
  SELECT m.* FROM m WHERE value > CASE metric WHEN 'view' THEN 55 ELSE 65 END
), runs AS (
  SELECT *, period - row_number() OVER (PARTITION BY metric ORDER BY period) * INTERVAL 1 HOUR AS g
  FROM over_limit)
SELECT metric, min(period) AS from_period, max(period) AS to_period, count(*) AS periods,
       max(value) AS worst
FROM runs GROUP BY metric, g HAVING count(*) >= CASE metric WHEN 'view' THEN 2 ELSE 3 END""")
def burn_alerts(spark, sf_dir):
    hourly = T.table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("metric"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period"),
    ).agg(F.round(F.avg("value"), 6).alias("value"))
    rules = hourly.select("metric").distinct().select(
        "metric",
        F.when(F.col("metric") == "view", 55).otherwise(65).alias("limit"),
        F.when(F.col("metric") == "view", 2).otherwise(3).alias("for_periods"),
    )
    return O.slo_breaches(hourly, rules, "1 HOUR")


@query(sql("""
SELECT event_id, CAST(day AS VARCHAR) AS day, round(spent, 6) AS spent,
       CASE WHEN path <> 'agent' THEN 'run' WHEN spent > 5 THEN 'queue' WHEN spent >= 4 THEN 'warn'
            ELSE 'run' END AS action
FROM (SELECT event_id, CAST(ts AS DATE) AS day, path,
             sum(CASE WHEN path = 'agent' THEN value / 2000 ELSE 0 END)
               OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS spent
      FROM scored)""", T.SCORED_SQL))
def spend_allocation(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select(
        "event_id", "ts", "path", (F.col("value") / 2000).alias("cost")
    )
    out = O.allocate_spend(rows, "ts", "event_id", "cost")
    return _text_day(_round(out, "spent")).select("event_id", "day", "spent", "action")


@query(sql("""
SELECT event_type, region, n, round(rate, 6) AS rate,
       round(rate - min(rate) OVER (PARTITION BY event_type), 6) AS gap
FROM (SELECT s.event_type, n.n_regionkey AS region, count(*) AS n,
             avg(CAST(s.correct AS DOUBLE)) AS rate
      FROM scored s JOIN nation n ON n.n_nationkey = s.user_id % 25
      GROUP BY 1, 2 HAVING count(*) >= 300)""", T.SCORED_SQL))
def fairness(spark, sf_dir):
    rows = T.scored(spark, sf_dir).withColumn("tract", (F.col("user_id") % 25).cast("int"))
    areas = T.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("tract"), F.col("n_regionkey").alias("region")
    )
    out = O.fairness_audit(rows, areas, "tract", "region", "event_type", "correct", 300)
    return _round(out, "rate", "gap")


FEEDBACK_SQL = """
reviewed AS (
  SELECT s.event_id, s.path, s.k,
         CASE k % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'edit' ELSE 'reject' END AS review_status,
         CASE WHEN k % 2 = 0 THEN 'wrong agency' END AS reject_reason,
         CASE WHEN event_id % 4 = 0 THEN correct END AS audit_ok
  FROM scored s
), labelled AS (
  SELECT *, coalesce(audit_ok, review_status = 'approve') AS label,
         CASE WHEN audit_ok IS NOT NULL AND NOT (review_status = 'approve' AND audit_ok) THEN 'strong'
              WHEN review_status = 'edit' THEN 'strong'
              WHEN review_status = 'reject' AND reject_reason IS NOT NULL THEN 'strong'
              WHEN review_status = 'approve' AND audit_ok THEN 'medium' ELSE 'weak' END AS strength
  FROM reviewed
)"""


def _labelled(spark, sf_dir):
    rows = T.scored(spark, sf_dir)
    reviews = rows.select(
        "event_id",
        "path",
        F.expr("CASE k % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'edit' ELSE 'reject' END").alias(
            "review_status"
        ),
        F.when(F.col("k") % 2 == 0, "wrong agency").alias("reject_reason"),
    )
    audits = rows.filter("event_id % 4 = 0").select("event_id", F.col("correct").alias("audit_ok"))
    return O.feedback_labels(reviews, audits, "event_id")


@query(sql("SELECT event_id, label, strength FROM labelled", T.SCORED_SQL, FEEDBACK_SQL))
def feedback_strength(spark, sf_dir):
    return _labelled(spark, sf_dir).select("event_id", "label", "strength")


@query(sql("""
SELECT path, count(*) FILTER (review_status = 'approve' AND audit_ok IS NOT NULL) AS audited,
       round(count(*) FILTER (review_status = 'approve' AND NOT audit_ok)
             / count(*) FILTER (review_status = 'approve' AND audit_ok IS NOT NULL), 6) AS wrong_rate
FROM labelled GROUP BY path""", T.SCORED_SQL, FEEDBACK_SQL))
def wrong_approvals(spark, sf_dir):
    return _round(O.wrong_approval_rate(_labelled(spark, sf_dir), ["path"]), "wrong_rate")
