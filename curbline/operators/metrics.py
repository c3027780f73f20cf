"""Quality metrics as grouped aggregates: every one reduces before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordering import with_running

CHEAP_MIN = 0.7


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(F.lit(2.0) * precision * recall, precision + recall),
    }


def precision_recall_f1(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    t, p = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in (truth, pred))
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
    )
    return counts.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def per_class(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    """One-versus-rest counts and scores per class, from the confusion counts."""
    cells = confusion(df, truth, pred, by)
    hit = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("class"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                    F.lit(0).cast("bigint").alias("fp"),
                    F.when(hit, 0).otherwise(F.col("n")).alias("fn"),
                ),
                F.struct(
                    F.col("pred").alias("class"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
                    F.lit(0).cast("bigint").alias("fn"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    counts = (
        sides.filter(F.col("class").isNotNull())
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )
    return counts.withColumns(_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(df: DataFrame, truth: str, pred: str, by=()) -> DataFrame:
    scores = per_class(df, truth, pred, by)
    return scores.groupBy(*by).agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.count("*").alias("classes")
    )


def false_confidence(
    df: DataFrame, tier: str, conf: str, correct: str, min_confidence: float = CHEAP_MIN, by=()
) -> DataFrame:
    """Wrong share, and number, of confident cheap-tier predictions."""
    hot = F.col(tier).startswith("cheap") & (F.col(conf) >= min_confidence)
    n = F.count_if(hot)
    return df.groupBy(*by).agg(
        ratio(F.count_if(hot & ~F.col(correct)), n).alias("false_confidence"), n.alias("n_confident")
    )


def cohen_kappa(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Chance-corrected agreement; 0 without rows, 1 if agreement is certain by chance."""
    cells = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
        F.count("*").alias("n")
    )
    same = F.col("_a").eqNullSafe(F.col("_b"))
    sides = cells.select(
        *by,
        "n",
        same.alias("same"),
        F.posexplode(F.array("_a", "_b")).alias("side", "category"),
    )
    marginal = sides.groupBy(*by, "category").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when((F.col("side") == 0) & F.col("same"), F.col("n")).otherwise(0)).alias("agree"),
    )
    total = marginal.groupBy(*by).agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("n"),
        F.sum("agree").alias("agree"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"),
    )
    n = F.col("n").cast("double")
    po, pe = F.col("agree") / n, F.col("chance") / (n * n)
    return total.select(
        *by,
        "n",
        F.when(F.col("n") == 0, 0.0)
        .when(F.col("chance") == n * n, 1.0)
        .otherwise(F.try_divide(po - pe, 1 - pe))
        .alias("kappa"),
    )


def evaluate_pairs(df: DataFrame, prediction: Column) -> DataFrame:
    """Scores of a pair predictor against ``label``, with annotator agreement."""
    scored = df.withColumn("_pred", prediction)
    counts = precision_recall_f1(scored, "label", "_pred")
    kappa = cohen_kappa(scored, "ann1", "ann2")
    return counts.join(F.broadcast(kappa))  # one row each


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def risk_coverage(
    df: DataFrame, conf: str, correct: str, tolerance: float | None = None
) -> DataFrame:
    """Fast share and fast error for every possible threshold.

    With ``tolerance``: only the lowest threshold whose error is within it.
    """
    scores = (
        df.filter(F.col(conf).isNotNull())
        .groupBy(F.col(conf).alias("threshold"))
        .agg(F.count("*").alias("n"), F.count_if(~F.col(correct)).alias("wrong"))
    )
    total = df.agg(F.count("*").alias("total"))
    swept = with_running(
        scores,
        [F.col("threshold").desc()],
        {"fast": F.col("n"), "fast_wrong": F.col("wrong")},
    ).join(F.broadcast(total))  # one row
    curve = swept.select(
        "threshold",
        "fast",
        (F.col("fast") / F.col("total")).alias("coverage"),
        (F.col("fast_wrong") / F.col("fast")).alias("error"),
    )
    if tolerance is None:
        return curve
    return curve.filter(F.col("error") <= tolerance).orderBy("threshold").limit(1)


# Mixing constants of the replicate weights; any engine gets the same.
MIX_PRIME = 2_147_483_647
MIX_KEY = 48_271
MIX_REP = 69_621
MIX_STEP = 16_807
# Cumulative Poisson(1) probabilities.
POISSON_STEPS = (
    0.367879441171,
    0.735758882343,
    0.919698602929,
    0.981011843124,
    0.996340153173,
    0.999405815182,
    0.999916758851,
)


def replicate_weight(key: Column, rep: Column, seed: int) -> Column:
    """Poisson(1) weight of a row in a replicate, by integer arithmetic on its key."""
    x = (F.pmod(key, F.lit(MIX_PRIME)) * MIX_KEY + rep * MIX_REP + seed) % MIX_PRIME
    x = (x * x + MIX_STEP) % MIX_PRIME
    x = (x * x + rep) % MIX_PRIME
    u = x / F.lit(float(MIX_PRIME))
    weight = F.lit(0)
    for step in POISSON_STEPS:
        weight = weight + F.when(u >= step, 1).otherwise(0)
    return weight


def bootstrap_replicates(
    df: DataFrame, key: str, delta: Column, reps: int = 200, seed: int = 11, by=()
) -> DataFrame:
    """Weighted mean of ``delta`` per replicate.

    Rows are repeated per replicate only inside the map side of the aggregate:
    what is shuffled is one partial sum per replicate and task.
    """
    rep = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint")))
    spread = df.select(*by, F.col(key).cast("bigint").alias("_k"), delta.alias("_d")).select(
        "*", rep.alias("rep")
    )
    w = replicate_weight(F.col("_k"), F.col("rep"), seed)
    return spread.groupBy(*by, "rep").agg(
        (F.sum(w * F.col("_d")) / F.sum(w).cast("double")).alias("mean")
    )


def bootstrap_ci(
    df: DataFrame, key: str, a: str, b: str, reps: int = 200, seed: int = 11, by=()
) -> DataFrame:
    """Mean of correct(a) - correct(b) with the 2.5 % and 97.5 % replicate quantiles."""
    delta = F.col(a).cast("int") - F.col(b).cast("int")
    means = bootstrap_replicates(df, key, delta, reps, seed, by)
    ends = means.groupBy(*by).agg(  # ``reps`` values per group
        F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high")
    )
    point = df.groupBy(*by).agg(F.avg(delta).alias("delta"), F.count("*").alias("n"))
    if not by:
        return point.join(F.broadcast(ends))  # one row each
    return point.join(ends, list(by))


def mcnemar(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic (0 without any)."""
    only_a = F.count_if(F.col(a) & ~F.col(b))
    only_b = F.count_if(~F.col(a) & F.col(b))
    counts = df.groupBy(*by).agg(only_a.alias("only_a"), only_b.alias("only_b"))
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return counts.withColumn("statistic", ratio(gap * gap, F.col("only_a") + F.col("only_b")))


def compare_conditions(df: DataFrame, by=("condition",)) -> DataFrame:
    """Per condition: coverage, correctness of what was routed, right abstentions, cost.

    Columns: ``abstained``, ``should_abstain``, ``correct`` (BOOLEAN), ``cost``.
    """
    routed = ~F.col("abstained")
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"),
        ratio(F.count_if(routed), n).alias("coverage"),
        ratio(F.count_if(routed & F.col("correct")), F.count_if(routed)).alias("correctness"),
        ratio(
            F.count_if(F.col("abstained") & F.col("should_abstain")), F.count_if("abstained")
        ).alias("right_abstention"),
        F.sum("cost").alias("cost"),
        ratio(F.sum("cost"), F.count_if(routed)).alias("cost_per_route"),
    )


def split_metrics(df: DataFrame, truth_set: str, pred_set: str) -> DataFrame:
    """Mean exact match, precision, recall and Jaccard of predicted agency sets."""
    t, p = F.array_distinct(truth_set), F.array_distinct(pred_set)
    both, either = F.size(F.array_intersect(t, p)), F.size(F.array_union(t, p))
    rows = df.select(
        (F.array_sort(t) == F.array_sort(p)).cast("int").alias("exact"),
        ratio(both, F.size(p)).alias("precision"),
        ratio(both, F.size(t)).alias("recall"),
        F.when(either == 0, 1.0).otherwise(ratio(both, either)).alias("jaccard"),
    )
    return rows.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(c) for c in ("exact", "precision", "recall", "jaccard")],
    )


def end_to_end_rate(df: DataFrame, stages: list[str]) -> DataFrame:
    """Share of rows right at every stage, against the product of the stage rates."""
    whole = F.lit(True)
    product = F.lit(1.0)
    rates = []
    for s in stages:
        whole = whole & F.col(s)
        rate = ratio(F.count_if(s), F.count("*"))
        rates.append(rate.alias(f"{s}_rate"))
        product = product * rate
    measured = ratio(F.count_if(whole), F.count("*"))
    return df.agg(
        F.count("*").alias("n"),
        *rates,
        measured.alias("end_to_end"),
        product.alias("stage_product"),
        (measured - product).alias("gap"),
    )


def metric_deltas(old: DataFrame, new: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Change per metric between two runs and whether it exceeds its tolerance.

    ``old``/``new``: ``metric, value``. ``tolerance``: ``metric, tolerance,
    higher_is_better``. A metric missing in the new run is a regression.
    """
    o = old.select("metric", F.col("value").alias("old"))
    n = new.select("metric", F.col("value").alias("new"))
    joined = o.join(n, "metric", "full_outer").join(tolerance, "metric", "left")
    change = F.col("new") - F.col("old")
    worse = F.when(F.coalesce("higher_is_better", F.lit(True)), -change).otherwise(change)
    return joined.select(
        "metric",
        "old",
        "new",
        change.alias("delta"),
        F.when(F.col("new").isNull(), True)
        .when(F.col("old").isNull(), False)
        .otherwise(worse > F.coalesce("tolerance", F.lit(0.0)))
        .alias("regressed"),
    )


def study_summary(df: DataFrame, key: str, margin: float, control: str, reps: int = 200):
    """Workflow study: per condition means, and non-inferiority against ``control``.

    Columns: ``case_id``-like ``key`` (shared by both conditions), ``condition``,
    ``correct``, ``minutes``, ``touches``, ``overridden``, ``false_split``,
    ``missed_split``.
    """
    n = F.count("*")
    means = df.groupBy("condition").agg(
        n.alias("n"),
        ratio(F.count_if("correct"), n).alias("correctness"),
        F.avg("minutes").alias("minutes"),
        F.avg("touches").alias("touches"),
        ratio(F.count_if("overridden"), n).alias("override_rate"),
        ratio(F.count_if("false_split"), n).alias("false_split_rate"),
        ratio(F.count_if("missed_split"), n).alias("missed_split_rate"),
    )
    base = df.filter(F.col("condition") == control).select(
        key, F.col("correct").alias("_c"), F.col("minutes").alias("_m")
    )
    paired = df.filter(F.col("condition") != control).join(base, key)

    def interval(delta: Column, name: str) -> DataFrame:
        reps_ = bootstrap_replicates(paired, key, delta, reps, by=["condition"])
        return reps_.groupBy("condition").agg(  # ``reps`` values per condition
            F.percentile("mean", 0.025).alias(f"{name}_low"),
            F.percentile("mean", 0.975).alias(f"{name}_high"),
        )

    right = interval(F.col("correct").cast("int") - F.col("_c").cast("int"), "correct_delta")
    time = interval(F.col("minutes") - F.col("_m"), "minutes_delta")
    return (
        means.join(right, "condition", "left")
        .join(time, "condition", "left")
        .withColumn(
            "non_inferior", F.coalesce(F.col("correct_delta_low") > -margin, F.lit(True))
        )
    )


def lagged(df: DataFrame, order: str, columns: list[str], by=()) -> DataFrame:
    """Change of per-period metrics against the previous period (one row per period)."""
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(w) for c in columns})
