"""Total orders over whole tables without a single-task sort.

Spark evaluates a window without a partition key, or with one hot key, in one
task. Here a table is laid out in ranges of the full sort key first, so a hot
group spreads over many ranges; per-range totals (one small row per range and
group) give each range its offset, and the window then works inside a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import settle, shuffle_width

RANGE = "_range"


def _cols(items) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def ranged(df: DataFrame, order, ranges: int | None = None) -> DataFrame:
    """Range-partition by the full sort key and remember each row's range."""
    n = ranges or shuffle_width(df.sparkSession)
    laid = df.repartitionByRange(n, *_cols(order))
    return settle(laid.withColumn(RANGE, F.spark_partition_id()))


def _renamed(df: DataFrame, by) -> DataFrame:
    """The same rows with their group columns under names that do not clash in a join."""
    return df.withColumnsRenamed({c: f"_g_{c}" for c in by})


def _same_group(by) -> Column:
    pairs = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    return reduce(lambda a, b: a & b, pairs)


def with_running(
    df: DataFrame, order, measures: dict[str, Column], by=(), ranges: int | None = None
) -> DataFrame:
    """Add running sums (inclusive) of ``measures`` in ``order`` within ``by``.

    ``order`` must be unique within ``by``. Without ``by`` the rows are shuffled once:
    see ``_scanned``.
    """
    if not by:
        typed = df.withColumns({f"_m_{k}": v for k, v in measures.items()})
        kinds = {typed.schema[f"_m_{k}"].dataType.typeName() for k in measures}
        if kinds <= {"long", "integer", "double"}:
            return _scanned(typed, order, list(measures), ranges)
    laid = ranged(
        df.withColumns({f"_m_{k}": v for k, v in measures.items()}), [*by, *order], ranges
    )
    subtotal = laid.groupBy(*by, RANGE).agg(*[F.sum(f"_m_{k}").alias(f"_s_{k}") for k in measures])
    ahead = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = subtotal.select(
        *by,
        RANGE,
        *[F.coalesce(F.sum(f"_s_{k}").over(ahead), F.lit(0)).alias(f"_o_{k}") for k in measures],
    )
    inside = (
        W.partitionBy(*by, RANGE)
        .orderBy(*_cols(order))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    group = [*by, RANGE]
    joined = laid.join(_renamed(offsets, group), _same_group(group))
    return joined.withColumns(
        {k: F.sum(f"_m_{k}").over(inside) + F.col(f"_o_{k}") for k in measures}
    ).drop(
        RANGE,
        *[f"_g_{c}" for c in group],
        *[f"_{kind}_{k}" for k in measures for kind in ("m", "o")],
    )


def _scanned(df: DataFrame, order, names: list[str], ranges: int | None) -> DataFrame:
    """Running sums of the columns ``_m_<name>`` over the whole table, with a single shuffle.

    The rows lie sorted in ranges of the order. One row of sums per range comes to the
    driver (as many as there are shuffle partitions), and every range adds its offset while
    it is read in order. NULL measures add nothing.
    """
    laid = df.repartitionByRange(ranges or shuffle_width(df.sparkSession), *_cols(order))
    laid = settle(laid.sortWithinPartitions(*_cols(order)).withColumn(RANGE, F.spark_partition_id()))
    sums = laid.groupBy(RANGE).agg(*[F.coalesce(F.sum(f"_m_{k}"), F.lit(0)).alias(k) for k in names])
    totals = {r[RANGE]: [r[k] for k in names] for r in sums.collect()}
    offsets, upto = {}, [0] * len(names)
    for part in sorted(totals):
        offsets[part] = list(upto)
        upto = [a + b for a, b in zip(upto, totals[part])]
    kept = [c for c in df.columns if c not in {*names, *(f"_m_{k}" for k in names)}]
    kinds = ["double" if laid.schema[f"_m_{k}"].dataType.typeName() == "double" else "bigint" for k in names]
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept), *(f"`{k}` {t}" for k, t in zip(names, kinds))]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = list(offsets[batch.column(RANGE)[0].as_py()])
            columns = []
            for i, (k, kind) in enumerate(zip(names, kinds)):
                wide = pa.float64() if kind == "double" else pa.int64()
                values = batch.column(f"_m_{k}").cast(wide).fill_null(0).to_numpy(zero_copy_only=False)
                running = np.cumsum(np.concatenate([[at[i]], values]))[1:]
                at[i] = running[-1].item()
                columns.append(pa.array(running, wide))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *names])

    return laid.mapInArrow(run, schema)


def with_rank(df: DataFrame, order, by=(), name: str = "rank", ranges=None) -> DataFrame:
    """Add the 1-based position in ``order`` within ``by``."""
    return with_running(df, order, {name: F.lit(1).cast("bigint")}, by, ranges)


def temporal_split(
    df: DataFrame, ts: str, key: str, fraction: float = 0.5, name: str = "part"
) -> DataFrame:
    """Label the earliest ``floor(n * fraction)`` rows ``calib``, the rest ``test``.

    NULL times come last; equal times are ordered by ``key``.
    """
    placed = with_rank(df, [F.col(ts).asc_nulls_last(), F.col(key).asc()], name="_pos")
    size = df.agg(F.floor(F.count("*") * fraction).alias("_cut"))
    return placed.join(F.broadcast(size)).select(  # one row
        "*", F.when(F.col("_pos") <= F.col("_cut"), "calib").otherwise("test").alias(name)
    ).drop("_pos", "_cut")


def top_k(df: DataFrame, by, order, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark limits groups before the shuffle."""
    w = W.partitionBy(*by).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_n(df: DataFrame, order, n: int) -> DataFrame:
    return df.orderBy(*_cols(order)).limit(n)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by) -> DataFrame:
    """Nearest-rank quantiles: the smallest value that covers share ``p`` of its group."""
    # The range layout samples its input and the group sizes read it again: count once.
    counted = settle(
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    )
    placed = with_running(counted, [F.col(value).asc()], {"_upto": F.col("_n")}, by)
    size = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if by:
        joined = placed.join(_renamed(size, by), _same_group(by))
    else:
        joined = placed.join(F.broadcast(size))  # one row
    return joined.groupBy(*by).agg(
        F.max("_size").alias("n"),
        *[
            F.min(F.when(F.col("_upto") >= F.lit(p) * F.col("_size"), F.col(value))).alias(name)
            for name, p in probs.items()
        ],
    )
