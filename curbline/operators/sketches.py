"""Mergeable summaries: distinct counts and quantiles that are kept per day and added up later.

Exact counts and quantiles shuffle every value. A sketch of bounded size is made
map-side instead, stored per day and group, and merged over any span of days without the
rows. Exact operators stay the default; these state their error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Binary logarithm of the buckets of a distinct count: relative error about 1.04 / sqrt(2 ** 12) = 1.6 %.
LOG_BUCKETS = 12
#: Size of a quantile sketch: rank error below 1.4 % with 99 % confidence.
QUANTILE_SIZE = 200


def sketched(
    df: DataFrame,
    by: list[str],
    distinct: dict[str, str] | None = None,
    quantiles: dict[str, str] | None = None,
) -> DataFrame:
    """One row per group of ``by``: ``n``, and a binary sketch per entry of either dict (name: column).

    NULL values are in no sketch.
    """
    parts = [F.count("*").alias("n")]
    parts += [F.hll_sketch_agg(F.col(c).cast("string"), LOG_BUCKETS).alias(f"{k}_hll") for k, c in (distinct or {}).items()]
    parts += [F.kll_sketch_agg_double(F.col(c).cast("double"), QUANTILE_SIZE).alias(f"{k}_kll") for k, c in (quantiles or {}).items()]
    return df.groupBy(*by).agg(*parts)


def merged(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sketches of all rows of a group as one; merging in any order gives the same bounds."""
    parts = [F.sum("n").alias("n")]
    for c in sketches.columns:
        if c.endswith("_hll"):
            parts.append(F.hll_union_agg(c).alias(c))
        elif c.endswith("_kll"):
            parts.append(F.kll_merge_agg_double(c).alias(c))
    return sketches.groupBy(*by).agg(*parts)


def estimates(sketches: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The sketches' figures: ``<name>_distinct``, and ``<name>_<p>`` for every probability.

    A quantile sketch without values gives NULL.
    """
    out = []
    for c in sketches.columns:
        if c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c[:-4]}_distinct"))
        elif c.endswith("_kll"):
            filled = F.kll_sketch_get_n_double(c) > 0
            out += [
                F.when(filled, F.kll_sketch_get_quantile_double(c, F.lit(p))).alias(f"{c[:-4]}_{name}")
                for name, p in probabilities.items()
            ]
        else:
            out.append(F.col(c))
    return sketches.select(*out)
