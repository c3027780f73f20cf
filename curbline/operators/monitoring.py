"""Drift, operations, spend, alerts and fairness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .governance import chosen
from .metrics import lagged, ratio
from .ordering import exact_quantiles, with_running

SMOOTHING = 1.0
ECE_LIMIT = 0.08
DAILY_CEILING = 5.00
WARN_SHARE = 0.8


def psi(df: DataFrame, is_reference: Column, column: str, smoothing: float = SMOOTHING):
    """Population stability index and KL divergence of ``column`` against the reference rows."""
    counts = df.groupBy(column).agg(
        F.count_if(is_reference).alias("ref"), F.count_if(~is_reference).alias("cur")
    )
    total = counts.agg(
        F.sum("ref").alias("ref_n"), F.sum("cur").alias("cur_n"), F.count("*").alias("k")
    )
    shares = counts.join(F.broadcast(total)).select(  # one row
        ((F.col("ref") + smoothing) / (F.col("ref_n") + smoothing * F.col("k"))).alias("p"),
        ((F.col("cur") + smoothing) / (F.col("cur_n") + smoothing * F.col("k"))).alias("q"),
    )
    return shares.agg(
        F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"),
        F.sum(F.col("q") * F.log(F.col("q") / F.col("p"))).alias("kl"),
        F.count("*").alias("categories"),
    )


def centroids(df: DataFrame, vector: str, by=()) -> DataFrame:
    """Mean vector per group as rows (``by, pos, mean``); sums are combined map-side."""
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    return parts.groupBy(*by, "pos").agg(F.avg("x").alias("mean"))


def centroid_shift(df: DataFrame, is_reference: Column, vector: str) -> DataFrame:
    """Cosine distance between the mean vectors of reference and current rows."""
    sides = df.withColumn("_ref", is_reference)
    c = centroids(sides, vector, ["_ref"])
    wide = c.groupBy("pos").agg(
        F.max(F.when(F.col("_ref"), F.col("mean"))).alias("a"),
        F.max(F.when(~F.col("_ref"), F.col("mean"))).alias("b"),
    )
    norm = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    return wide.agg((1 - F.sum(F.col("a") * F.col("b")) / norm).alias("shift"))


def turn_statistics(trace: DataFrame, key: str, turn: str, gave_up: Column) -> DataFrame:
    """Histogram of turns per case, with the share of cases that were given up."""
    cases = trace.groupBy(key).agg(
        F.max(turn).alias("last_turn"), F.bool_or(gave_up).alias("gave_up")
    )
    return cases.groupBy((F.col("last_turn") + 1).alias("turns")).agg(
        F.count("*").alias("cases"), F.count_if("gave_up").alias("given_up")
    )


def trace_assertions(
    trace: DataFrame, key: str, turn: str, before: Column, after: Column
) -> DataFrame:
    """Cases in which an event ``after`` is not preceded by an event ``before``."""
    first = trace.groupBy(key).agg(
        F.min(F.when(before, F.col(turn))).alias("first_before"),
        F.min(F.when(after, F.col(turn))).alias("first_after"),
    )
    broken = F.col("first_after").isNotNull() & (
        F.col("first_before").isNull() | (F.col("first_before") >= F.col("first_after"))
    )
    return first.withColumn("broken", broken)


def behaviour_drift(df: DataFrame, day: str, measures: dict[str, Column]) -> DataFrame:
    """Daily measures and their change against the day before."""
    daily = df.groupBy(F.to_date(day).alias("day")).agg(
        *[c.alias(name) for name, c in measures.items()]
    )
    return lagged(daily, "day", list(measures))


def ops_metrics(df: DataFrame, by: list[str], latency: str, cost: str, ceiling: float) -> DataFrame:
    """Volume, exact p95 latency, cost, error, retry and override rates per group.

    Columns ``error``, ``overridden`` (BOOLEAN) and ``retries``.
    """
    n = F.count("*")
    base = df.groupBy(*by).agg(
        n.alias("tickets"),
        F.sum(cost).alias("cost"),
        ratio(F.sum(cost), n).alias("cost_per_ticket"),
        ratio(F.sum(cost), F.lit(ceiling)).alias("spend_share"),
        ratio(F.count_if("error"), n).alias("error_rate"),
        ratio(F.sum("retries"), n).alias("retries_per_ticket"),
        ratio(F.count_if("overridden"), n).alias("override_rate"),
    )
    p95 = exact_quantiles(df, latency, {"p95": 0.95}, by).drop("n")
    return base.join(p95, by, "left")


def slo_breaches(metrics: DataFrame, rules: DataFrame, step: str) -> DataFrame:
    """Breaches that last: consecutive periods over the limit, at least ``for_periods``.

    ``metrics``: ``metric, period, value`` (one row per metric and period);
    ``rules``: ``metric, limit, for_periods``. ``step`` is the length of a
    period, e.g. '1 hour'; a missing period ends a breach.
    """
    over = metrics.join(rules, "metric").filter(F.col("value") > F.col("limit"))
    w = W.partitionBy("metric").orderBy("period")
    runs = over.withColumn(
        "_start",
        F.when(
            F.lag("period").over(w) == F.col("period") - F.expr(f"INTERVAL {step}"), 0
        ).otherwise(1),
    ).withColumn("_run", F.sum("_start").over(w))
    return (
        runs.groupBy("metric", "_run")
        .agg(
            F.min("period").alias("from_period"),
            F.max("period").alias("to_period"),
            F.count("*").alias("periods"),
            F.max("value").alias("worst"),
            F.first("for_periods").alias("_need"),
        )
        .filter(F.col("periods") >= F.col("_need"))
        .drop("_run", "_need")
    )


def allocate_spend(
    df: DataFrame, ts: str, key: str, cost: str, ceiling: float = DAILY_CEILING, path: str = "path"
) -> DataFrame:
    """Running agent spend per day in arrival order, and what happens to each ticket.

    Fast tickets always run. An agent ticket runs while the day's spend stays
    within the ceiling, with a warning from 80 % on, and is queued beyond it.
    """
    charged = df.withColumn("_day", F.to_date(ts)).withColumn(
        "_cost", F.when(F.col(path) == "agent", F.col(cost)).otherwise(F.lit(0.0))
    )
    run = with_running(charged, [ts, key], {"spent": F.col("_cost")}, by=["_day"])
    return run.withColumn(
        "action",
        F.when(F.col(path) != "agent", "run")
        .when(F.col("spent") > ceiling, "queue")
        .when(F.col("spent") >= ceiling * WARN_SHARE, "warn")
        .otherwise("run"),
    ).withColumnRenamed("_day", "day").drop("_cost")


def fairness_audit(
    df: DataFrame, areas: DataFrame, area: str, group: str, within: str, outcome: str, min_n: int
) -> DataFrame:
    """Outcome rate by area group within complaint type; small cells are not shown."""
    cells = (
        df.join(areas.select(area, group), area)
        .groupBy(within, group)
        .agg(F.count("*").alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate"))
        .filter(F.col("n") >= min_n)
    )
    w = W.partitionBy(within)
    return cells.withColumn("gap", F.col("rate") - F.min("rate").over(w))


def feedback_labels(reviews: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """Label and strength per review: audited > corrected > confirmed > approved.

    ``reviews``: key, ``review_status`` (approve/edit/reject), ``reject_reason``.
    ``audits``: key, ``audit_ok`` (BOOLEAN).
    """
    joined = reviews.join(audits.select(key, "audit_ok"), key, "left")
    status = F.col("review_status")
    approved = status == "approve"
    strength = (
        F.when(F.col("audit_ok").isNotNull() & ~(approved & F.col("audit_ok")), "strong")
        .when(status == "edit", "strong")
        .when((status == "reject") & F.col("reject_reason").isNotNull(), "strong")
        .when(approved & F.col("audit_ok"), "medium")
        .otherwise("weak")
    )
    label = F.coalesce(F.col("audit_ok"), approved)
    return joined.withColumn("label", label).withColumn("strength", strength)


def wrong_approval_rate(labels: DataFrame, by: list[str]) -> DataFrame:
    """Among audited approvals, the share the audit found wrong."""
    audited = (F.col("review_status") == "approve") & F.col("audit_ok").isNotNull()
    n = F.count_if(audited)
    return labels.groupBy(*by).agg(
        n.alias("audited"), ratio(F.count_if(audited & ~F.col("audit_ok")), n).alias("wrong_rate")
    )


def field_inventory(df: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """Per column: rows, NULL share, distinct values, median and p95 length, top values."""
    n = len(columns)
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = df.select(F.expr(f"stack({n}, {stack}) AS (field, value)"))
    counted = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    base = counted.groupBy("field").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(F.col("value").isNotNull()).alias("n_distinct"),
    )
    lengths = (
        counted.filter(F.col("value").isNotNull())
        .groupBy("field", F.length("value").alias("len"))
        .agg(F.sum("n").alias("n"))
    )
    # One row per field and length here: as many as the longest value has characters.
    w = W.partitionBy("field").orderBy("len")
    placed = lengths.withColumn("upto", F.sum("n").over(w)).withColumn(
        "size", F.sum("n").over(W.partitionBy("field"))
    )
    quantile = placed.groupBy("field").agg(
        F.min(F.when(F.col("upto") >= 0.5 * F.col("size"), F.col("len"))).alias("len_p50"),
        F.min(F.when(F.col("upto") >= 0.95 * F.col("size"), F.col("len"))).alias("len_p95"),
    )
    best = W.partitionBy("field").orderBy(F.col("n").desc(), "value")
    tops = (
        counted.filter(F.col("value").isNotNull())
        .withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") <= top)
        .groupBy("field")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "value", "n"))).alias("tops"))
    )
    return (
        base.join(quantile, "field", "left")
        .join(tops, "field", "left")
        .select(
            "field",
            "n_rows",
            ratio(F.col("nulls"), F.col("n_rows")).alias("null_share"),
            "n_distinct",
            "len_p50",
            "len_p95",
            F.transform("tops", lambda t: F.struct(t["value"], t["n"])).alias("top_values"),
        )
    )


def stratified_sample(df: DataFrame, by: str, key: str, share: float) -> DataFrame:
    """A reproducible share of every stratum, chosen by key hash."""
    return df.filter(chosen(share, F.col(by), F.col(key)))
