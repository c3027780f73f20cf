"""Quality-metric queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.calibration import tier_calibration
from ..plans import tables as T
from ..plans.tables import sql
from .collect import collection

query, QUERIES, SQL = collection()


def _round(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("""
SELECT source, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT d.source, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS tp,
             count(*) FILTER (l.quality <> 1 AND l.toxic = 0) AS fp,
             count(*) FILTER (l.quality = 1 AND l.toxic <> 0) AS fn
      FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source)""")
def precision_recall(spark, sf_dir):
    rows = T.table(spark, sf_dir, "labels").join(
        T.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"
    ).select("source", (F.col("quality") == 1).alias("t"), (F.col("toxic") == 0).alias("p"))
    return _round(M.precision_recall_f1(rows, "t", "p", ["source"]), "precision", "recall", "f1")


@query(sql("SELECT truth, pred, count(*) AS n FROM scored GROUP BY 1, 2", T.SCORED_SQL))
def confusion_matrix(spark, sf_dir):
    return M.confusion(T.scored(spark, sf_dir), "truth", "pred")


F1_SQL = """
classes AS (
  SELECT DISTINCT tier, x AS c FROM (
    SELECT tier, truth AS x FROM scored UNION SELECT tier, pred FROM scored) WHERE x IS NOT NULL
), f1s AS (
  SELECT s.tier, c, count(*) FILTER (truth = c AND pred = c) AS tp,
         count(*) FILTER (truth <> c AND pred = c) AS fp,
         count(*) FILTER (truth = c AND (pred IS NULL OR pred <> c)) AS fn
  FROM classes k JOIN scored s ON s.tier = k.tier GROUP BY s.tier, c
)"""


@query(sql("""
SELECT tier, c AS class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM f1s""", T.SCORED_SQL, F1_SQL))
def class_scores(spark, sf_dir):
    rows = M.per_class(T.scored(spark, sf_dir), "truth", "pred", ["tier"])
    return _round(rows, "precision", "recall", "f1")


@query(sql("""
SELECT tier, round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1,
       count(*) AS classes
FROM f1s GROUP BY tier""", T.SCORED_SQL, F1_SQL))
def macro_f1(spark, sf_dir):
    return _round(M.macro_f1(T.scored(spark, sf_dir), "truth", "pred", ["tier"]), "macro_f1")


@query(sql("""
SELECT round(count(*) FILTER (NOT correct) / count(*), 6) AS false_confidence,
       count(*) AS n_confident
FROM scored WHERE tier LIKE 'cheap%' AND conf >= 0.7""", T.SCORED_SQL))
def false_confidence(spark, sf_dir):
    rows = M.false_confidence(T.scored(spark, sf_dir), "tier", "conf", "correct")
    return _round(rows, "false_confidence")


@query(sql("""
SELECT s.n, round((s.agree / s.n - m.pe) / (1 - m.pe), 6) AS kappa
FROM (SELECT count(*) AS n, count(*) FILTER (truth IS NOT DISTINCT FROM pred) AS agree FROM scored) s,
     (SELECT sum(a.n * CAST(b.n AS DOUBLE)) / (SELECT count(*) * CAST(count(*) AS DOUBLE) FROM scored)
             AS pe
      FROM (SELECT truth AS c, count(*) AS n FROM scored GROUP BY 1) a
      JOIN (SELECT pred AS c, count(*) AS n FROM scored GROUP BY 1) b
        ON a.c IS NOT DISTINCT FROM b.c) m""", T.SCORED_SQL))
def annotator_kappa(spark, sf_dir):
    return _round(M.cohen_kappa(T.scored(spark, sf_dir), "truth", "pred"), "kappa")


SWEEP_SQL = """
swept AS (
  SELECT conf AS threshold, CAST(sum(n) OVER w AS BIGINT) AS fast,
         sum(n) OVER w / (SELECT count(*) FROM scored) AS coverage,
         sum(wrong) OVER w / sum(n) OVER w AS error
  FROM (SELECT conf, count(*) AS n, count(*) FILTER (NOT correct) AS wrong FROM scored GROUP BY conf)
  WINDOW w AS (ORDER BY conf DESC)
)"""


@query(sql("""
SELECT threshold, fast, round(coverage, 6) AS coverage, round(error, 6) AS error
FROM swept""", T.SCORED_SQL, SWEEP_SQL))
def risk_coverage(spark, sf_dir):
    return _round(M.risk_coverage(T.scored(spark, sf_dir), "conf", "correct"), "coverage", "error")


@query(sql("""
SELECT threshold, fast, round(coverage, 6) AS coverage, round(error, 6) AS error
FROM swept WHERE error <= 0.2 ORDER BY threshold LIMIT 1""", T.SCORED_SQL, SWEEP_SQL))
def gate_operating_point(spark, sf_dir):
    rows = M.risk_coverage(T.scored(spark, sf_dir), "conf", "correct", tolerance=0.2)
    return _round(rows, "coverage", "error")


BY_TIER_SQL = """
long AS (
  SELECT tier, '*' AS class, conf, correct FROM scored
  UNION ALL SELECT tier, truth, conf, correct FROM scored
), bins AS (
  SELECT tier, class, least(floor(conf * 10), 9) AS bin, avg(conf) AS m, count(*) AS n,
         count(*) FILTER (correct) / count(*) AS a, count(*) FILTER (NOT correct) AS wrong
  FROM long GROUP BY 1, 2, 3)"""


@query(sql("""
SELECT tier, class, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(a - m)) / sum(n), 6) AS ece,
       round(sum(wrong) / sum(n), 6) AS error_rate
FROM bins GROUP BY tier, class""", T.SCORED_SQL, BY_TIER_SQL))
def calibration_by_tier(spark, sf_dir):
    rows = tier_calibration(T.scored(spark, sf_dir), "conf", "correct", "tier", "truth")
    return _round(rows, "ece", "error_rate")


POISSON = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in M.POISSON_STEPS)
BOOT_SQL = f"""
reps AS (SELECT r FROM range(200) t(r)),
mixed AS (
  SELECT tier, d, r,
         ((event_id % 2147483647) * 48271 + r * 69621 + 11) % 2147483647 AS x0
  FROM (SELECT tier, event_id, CAST(correct AS INTEGER) - CAST(correct_b AS INTEGER) AS d FROM scored),
       reps
), drawn AS (
  SELECT tier, d, r, ((x1 * x1 + r) % 2147483647) / CAST(2147483647 AS DOUBLE) AS u
  FROM (SELECT *, (x0 * x0 + 16807) % 2147483647 AS x1 FROM mixed)
), means AS (
  SELECT tier, r, sum(w * d) / CAST(sum(w) AS DOUBLE) AS m
  FROM (SELECT *, {POISSON} AS w FROM drawn) GROUP BY tier, r
)"""


@query(sql("""
SELECT s.tier, round(s.delta, 6) AS delta, s.n, round(quantile_cont(m.m, 0.025), 6) AS low,
       round(quantile_cont(m.m, 0.975), 6) AS high
FROM (SELECT tier, avg(CAST(correct AS INTEGER) - CAST(correct_b AS INTEGER)) AS delta, count(*) AS n
      FROM scored GROUP BY tier) s JOIN means m ON m.tier = s.tier
GROUP BY s.tier, s.delta, s.n""", T.SCORED_SQL, BOOT_SQL))
def bootstrap_interval(spark, sf_dir):
    rows = M.bootstrap_ci(T.scored(spark, sf_dir), "event_id", "correct", "correct_b", by=["tier"])
    return _round(rows, "delta", "low", "high")


@query(sql("""
SELECT tier, only_a, only_b, round(coalesce(power(greatest(abs(only_a - only_b) - 1, 0), 2)
         / nullif(only_a + only_b, 0), 0), 6) AS statistic
FROM (SELECT tier, count(*) FILTER (correct AND NOT correct_b) AS only_a,
             count(*) FILTER (NOT correct AND correct_b) AS only_b
      FROM scored GROUP BY tier)""", T.SCORED_SQL))
def paired_test(spark, sf_dir):
    rows = M.mcnemar(T.scored(spark, sf_dir), "correct", "correct_b", ["tier"])
    return _round(rows, "statistic")


@query(sql("""
SELECT tier AS condition, count(*) AS n, round(count(pred) / count(*), 6) AS coverage,
       round(coalesce(count(*) FILTER (pred IS NOT NULL AND correct) / nullif(count(pred), 0), 0), 6)
         AS correctness,
       round(coalesce(count(*) FILTER (pred IS NULL AND k < 30)
             / nullif(count(*) FILTER (pred IS NULL), 0), 0), 6) AS right_abstention,
       round(sum(value), 4) AS cost, round(sum(value) / count(pred), 6) AS cost_per_route
FROM scored GROUP BY tier""", T.SCORED_SQL))
def condition_table(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select(
        F.col("tier").alias("condition"),
        F.col("pred").isNull().alias("abstained"),
        (F.col("k") < 30).alias("should_abstain"),
        "correct",
        F.col("value").alias("cost"),
    )
    out = _round(M.compare_conditions(rows), "coverage", "correctness", "right_abstention", "cost_per_route")
    return _round(out, "cost", digits=4)


SETS_SQL = """
sets AS (
  SELECT list_filter([CASE WHEN k % 2 = 0 THEN 'DEP' END, CASE WHEN k % 3 = 0 THEN 'DOB' END,
                      CASE WHEN k % 5 = 0 THEN 'DOT' END], lambda x: x IS NOT NULL) AS t,
         list_filter([CASE WHEN k % 2 = 0 THEN 'DEP' END, CASE WHEN user_id % 3 = 0 THEN 'DOB' END],
                     lambda x: x IS NOT NULL) AS p
  FROM scored
), sized AS (
  SELECT len(list_intersect(t, p)) AS b, len(t) AS nt, len(p) AS np FROM sets)"""


@query(sql("""
SELECT count(*) AS n, round(avg(CASE WHEN b = nt AND b = np THEN 1 ELSE 0 END), 6) AS exact,
       round(avg(coalesce(b / nullif(np, 0), 0)), 6) AS "precision",
       round(avg(coalesce(b / nullif(nt, 0), 0)), 6) AS recall,
       round(avg(coalesce(b / nullif(nt + np - b, 0), 1)), 6) AS jaccard
FROM sized""", T.SCORED_SQL, SETS_SQL))
def split_sets(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select(
        F.array_compact(
            F.array(
                F.when(F.col("k") % 2 == 0, "DEP"),
                F.when(F.col("k") % 3 == 0, "DOB"),
                F.when(F.col("k") % 5 == 0, "DOT"),
            )
        ).alias("t"),
        F.array_compact(
            F.array(F.when(F.col("k") % 2 == 0, "DEP"), F.when(F.col("user_id") % 3 == 0, "DOB"))
        ).alias("p"),
    )
    return _round(M.split_metrics(rows, "t", "p"), "exact", "precision", "recall", "jaccard")


@query(sql("""
SELECT n, round(a, 6) AS routed_rate, round(b, 6) AS drafted_rate, round(c, 6) AS approved_rate,
       round(e, 6) AS end_to_end, round(a * b * c, 6) AS stage_product, round(e - a * b * c, 6) AS gap
FROM (SELECT count(*) AS n, count(*) FILTER (correct) / count(*) AS a,
             count(*) FILTER (correct_b) / count(*) AS b,
             count(*) FILTER (user_id % 7 <> 0) / count(*) AS c,
             count(*) FILTER (correct AND correct_b AND user_id % 7 <> 0) / count(*) AS e
      FROM scored)""", T.SCORED_SQL))
def compounding_error(spark, sf_dir):
    rows = T.scored(spark, sf_dir).select(
        F.col("correct").alias("routed"),
        F.col("correct_b").alias("drafted"),
        (F.col("user_id") % 7 != 0).alias("approved"),
    )
    out = M.end_to_end_rate(rows, ["routed", "drafted", "approved"])
    return _round(out, *[c for c in out.columns if c != "n"])


RUNS_SQL = """
old AS (SELECT 'accuracy_' || tier AS metric, count(*) FILTER (correct) / count(*) AS v
         FROM scored WHERE user_id % 2 = 0 GROUP BY tier),
new AS (SELECT 'accuracy_' || tier AS metric, count(*) FILTER (correct) / count(*) AS v
         FROM scored WHERE user_id % 2 = 1 GROUP BY tier)"""


@query(sql("""
SELECT coalesce(o.metric, n.metric) AS metric, round(o.v, 6) AS old, round(n.v, 6) AS new,
       round(n.v - o.v, 6) AS delta,
       CASE WHEN n.v IS NULL THEN true WHEN o.v IS NULL THEN false ELSE o.v - n.v > 0.001 END AS regressed
FROM old o FULL JOIN new n ON o.metric = n.metric""", T.SCORED_SQL, RUNS_SQL))
def run_deltas(spark, sf_dir):
    rows = T.scored(spark, sf_dir).withColumn("metric", F.concat(F.lit("accuracy_"), "tier"))

    def accuracy(df):
        return df.groupBy("metric").agg(
            (F.count_if("correct") / F.count("*")).alias("value")
        )

    tolerance = rows.select("metric").distinct().withColumns(
        {"tolerance": F.lit(0.001), "higher_is_better": F.lit(True)}
    )
    out = M.metric_deltas(
        accuracy(rows.filter("user_id % 2 = 0")),
        accuracy(rows.filter("user_id % 2 = 1")),
        tolerance,
    )
    return _round(out, "old", "new", "delta")


STUDY_SQL = f"""
study AS (
  SELECT event_id AS case_id, 'assisted' AS condition, correct, value AS minutes, k % 5 AS touches,
         k % 7 = 0 AS overridden, k % 11 = 0 AS false_split, k % 13 = 0 AS missed_split FROM scored
  UNION ALL
  SELECT event_id, 'unaided', correct_b, value + user_id % 9, k % 6, k % 4 = 0, k % 9 = 0, k % 8 = 0
  FROM scored
), paired AS (
  SELECT a.case_id, CAST(a.correct AS INTEGER) - CAST(b.correct AS INTEGER) AS dc,
         a.minutes - b.minutes AS dm
  FROM study a JOIN study b ON a.case_id = b.case_id AND a.condition = 'assisted'
                           AND b.condition = 'unaided'
), reps AS (SELECT r FROM range(100) t(r)),
drawn AS (
  SELECT dc, dm, r, ((x1 * x1 + r) % 2147483647) / CAST(2147483647 AS DOUBLE) AS u
  FROM (SELECT *, (x0 * x0 + 16807) % 2147483647 AS x1
        FROM (SELECT *, ((case_id % 2147483647) * 48271 + r * 69621 + 11) % 2147483647 AS x0
              FROM paired, reps))
), means AS (
  SELECT r, sum(w * dc) / CAST(sum(w) AS DOUBLE) AS mc, sum(w * dm) / CAST(sum(w) AS DOUBLE) AS mm
  FROM (SELECT *, {POISSON} AS w FROM drawn) GROUP BY r
), ends AS (
  SELECT quantile_cont(mc, 0.025) AS cl, quantile_cont(mc, 0.975) AS ch,
         quantile_cont(mm, 0.025) AS ml, quantile_cont(mm, 0.975) AS mh FROM means
)"""


@query(sql("""
SELECT condition, count(*) AS n, round(count(*) FILTER (correct) / count(*), 6) AS correctness,
       round(avg(minutes), 6) AS minutes, round(avg(touches), 6) AS touches,
       round(count(*) FILTER (overridden) / count(*), 6) AS override_rate,
       round(count(*) FILTER (false_split) / count(*), 6) AS false_split_rate,
       round(count(*) FILTER (missed_split) / count(*), 6) AS missed_split_rate,
       CASE WHEN condition = 'assisted' THEN round(any_value(cl), 6) END AS correct_delta_low,
       CASE WHEN condition = 'assisted' THEN round(any_value(ch), 6) END AS correct_delta_high,
       CASE WHEN condition = 'assisted' THEN round(any_value(ml), 6) END AS minutes_delta_low,
       CASE WHEN condition = 'assisted' THEN round(any_value(mh), 6) END AS minutes_delta_high,
       condition <> 'assisted' OR any_value(cl) > -0.05 AS non_inferior
FROM study, ends GROUP BY condition""", T.SCORED_SQL, STUDY_SQL))
def workflow_study(spark, sf_dir):
    s = T.scored(spark, sf_dir)

    def arm(name, correct, minutes, touches, o, f, m):
        return s.select(
            F.col("event_id").alias("case_id"), F.lit(name).alias("condition"),
            F.col(correct).alias("correct"), minutes.alias("minutes"), touches.alias("touches"),
            o.alias("overridden"), f.alias("false_split"), m.alias("missed_split"),
        )

    k = F.col("k")
    rows = arm(
        "assisted", "correct", F.col("value"), k % 5, k % 7 == 0, k % 11 == 0, k % 13 == 0
    ).unionByName(
        arm(
            "unaided", "correct_b", F.col("value") + F.col("user_id") % 9, k % 6,
            k % 4 == 0, k % 9 == 0, k % 8 == 0,
        )
    )
    out = M.study_summary(rows, "case_id", margin=0.05, control="unaided", reps=100)
    return _round(out, *[c for c, t in out.dtypes if t == "double"])
