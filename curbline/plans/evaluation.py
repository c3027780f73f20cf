"""The routing evaluation report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.taxonomy import clean_code
from ..functions.text import multi_agency
from ..operators.calibration import apply_isotonic, ece, fit_isotonic
from ..operators.metrics import CHEAP_MIN, false_confidence, macro_f1, ratio
from ..operators.ordering import first_n, temporal_split
from ..operators.routing import gate, select_tier
from ..operators.similarity import RECALL
from ..operators.voting import K, MAX_DISTANCE, cheap_tier
from ..runtime import settle

REPORT = (
    "n_calib",
    "n_test",
    "macro_f1",
    "accuracy",
    "ece",
    "cheap_false_confidence",
    "n_cheap_high_conf",
    "fast_fraction",
    "agent_fraction",
)


def judged_tickets(
    tickets: DataFrame,
    key: str = "id",
    tiers=(None, None),
    k: int = K,
    max_distance: float = MAX_DISTANCE,
    as_of: str | None = None,
    sample: int | None = None,
    cheap_min: float = CHEAP_MIN,
    method: str = "exact",
    recall: float = RECALL,
) -> DataFrame:
    """Every labelled ticket with its cheap and final prediction, calibrated and gated.

    Tickets without a vector and, where ``duplicate_of`` or ``status`` tells, duplicates are neither judged
    nor neighbours.

    The earlier half fits the calibrator and keeps ``part = 'calib'``. One
    neighbour search serves both the cheap tier and the cascade.
    """
    tickets = tickets.filter(F.col("vector").isNotNull())
    if "duplicate_of" in tickets.columns:
        tickets = tickets.filter(F.col("duplicate_of").isNull())
    if "status" in tickets.columns:
        tickets = tickets.filter(~F.col("status").eqNullSafe(F.lit("DUPLICATE")))
    subjects = tickets
    if sample is not None:
        subjects = first_n(
            tickets, [F.col("created_date").asc_nulls_last(), F.col(key).asc()], sample
        )
    truth = clean_code(F.col("agency"))
    subjects = subjects.withColumn("truth", truth).filter(F.col("truth").isNotNull())
    # Used by the cascade and by the cheap tier's own figures: search once.
    cheap = settle(
        cheap_tier(subjects, tickets, key, "vector", k, max_distance, as_of=as_of, method=method, recall=recall)
    )
    final = select_tier(cheap, *tiers, key=key, cheap_min=cheap_min)
    rows = (
        multi_agency(subjects.select(key, "created_date", "truth", "complaint_type", "descriptor"))
        .join(final, key)
        .join(
            cheap.select(key, F.col("tier").alias("cheap_tier"), F.col("confidence").alias("cheap_conf")),
            key,
        )
        .withColumn("correct", F.coalesce(F.col("truth") == F.col("agency"), F.lit(False)))
        .drop("descriptor")
    )
    # The range layout of the split samples its input first: compute the rows once.
    split = temporal_split(settle(rows), "created_date", key)
    model = fit_isotonic(split.filter("part = 'calib'"), "confidence", "correct")
    return gate(apply_isotonic(split, "confidence", model))


def routing_report(tickets: DataFrame, **options) -> DataFrame:
    """One row of counts and quality figures over the later half of the tickets."""
    rows = settle(judged_tickets(tickets, **options))
    test = rows.filter("part = 'test'")
    counts = rows.agg(
        F.count_if(F.col("part") == "calib").alias("n_calib"),
        F.count_if(F.col("part") == "test").alias("n_test"),
    )
    n = F.count("*")
    shares = test.agg(
        ratio(F.count_if("correct"), n).alias("accuracy"),
        ratio(F.count_if(F.col("path") == "fast"), n).alias("fast_fraction"),
        ratio(F.count_if(F.col("path") == "agent"), n).alias("agent_fraction"),
    )
    blame = false_confidence(test, "cheap_tier", "cheap_conf", "correct").withColumnsRenamed(
        {"false_confidence": "cheap_false_confidence", "n_confident": "n_cheap_high_conf"}
    )
    parts = [
        counts,
        shares,
        macro_f1(test, "truth", "agency").select("macro_f1"),
        ece(test, "calibrated", "correct").select("ece"),
        blame,
    ]
    long = reduce(DataFrame.unionByName, [_long(p) for p in parts])
    wide = long.groupBy().agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in REPORT]
    )
    return wide.withColumns({c: F.col(c).cast("bigint") for c in REPORT if c.startswith("n_")})


def _long(df: DataFrame) -> DataFrame:
    """A one-row result as ``metric, value`` rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in df.columns
        ]
    )
    return df.select(F.inline(pairs))
