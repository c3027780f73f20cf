"""Assertions over ordered events: patterns as small automata, folded per case.

A pattern reads a case's events in order and ends in a good or a bad state. Following a state
through a stretch of events is a map from states to states, and such maps can be
joined in order. So the events lie in ranges of (case, order): a case in a third of all rows spreads
over many tasks, each gives one map per case it holds, and the maps of a case are joined - as many
as there are ranges with its events, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import settle, shuffle_width


@dataclass(frozen=True)
class Pattern:
    """``moves[state][symbol]`` is the next state; state 0 starts, the last one is broken for good.

    Symbols: 0 neither, 1 the first kind of event, 2 the second, 3 both at once.
    ``good`` are the states in which a case may end.
    """

    first: Column
    second: Column
    moves: tuple[tuple[int, ...], ...]
    good: frozenset[int]


def precedes(first: Column, second: Column) -> Pattern:
    """No ``second`` event before a ``first`` one; at the same event they do not count as before."""
    waiting, seen, broken = 0, 1, 2
    return Pattern(first, second, ((waiting, seen, broken, broken), (seen,) * 4, (broken,) * 4), frozenset({waiting, seen}))


def answered_within(first: Column, second: Column, events: int) -> Pattern:
    """Every ``first`` event has a ``second`` one among the next ``events`` events of the case.

    The clock runs from the earliest event that is still unanswered, which is the one that runs out first.
    """
    if events < 1:
        raise ValueError("events is at least 1")
    broken = events + 1
    moves = [(0, 1, 0, 1)]  # state k: the earliest open event lies k events back
    for k in range(1, events + 1):
        late = k + 1 if k < events else broken
        moves.append((late, late, 0, 1))
    moves.append((broken,) * 4)
    return Pattern(first, second, tuple(moves), frozenset({0}))


def never_after(first: Column, second: Column) -> Pattern:
    """No ``second`` event behind a ``first`` one."""
    clear, armed, broken = 0, 1, 2
    return Pattern(first, second, ((clear, armed, clear, armed), (armed, armed, broken, broken), (broken,) * 4), frozenset({clear, armed}))


def check_traces(events: DataFrame, key: str, order: list[str], patterns: dict[str, Pattern]) -> DataFrame:
    """(key, pattern, broken) for every case and pattern.

    Events with equal ``order`` should not occur; conditions that are NULL count as false.
    """
    names = list(patterns)
    tables = [np.array(p.moves, np.int8) for p in patterns.values()]
    symbols = [
        (F.when(p.first, 1).otherwise(0) + F.when(p.second, 2).otherwise(0)).cast("tinyint").alias(f"_s{i}")
        for i, p in enumerate(patterns.values())
    ]
    rows = events.select(F.col(key).alias("_key"), *order, *symbols)
    laid = settle(
        rows.repartitionByRange(shuffle_width(events.sparkSession), "_key", *order)
        .sortWithinPartitions("_key", *order)
        .withColumn("_range", F.spark_partition_id())
    )
    key_type = events.schema[key].dataType.simpleString()

    def run(batches):
        at, maps, part = None, None, 0
        out: list = []

        def flushed():
            columns = [pa.array([r[i] for r in out]) for i in range(2)]
            listed = pa.array([[m.tolist() for m in r[2]] for r in out], pa.list_(pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays([columns[0].cast(kind), columns[1].cast(pa.int32()), listed], ["_key", "_range", "maps"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("_key").type
            steps = [batch.column(f"_s{i}").to_numpy() for i in range(len(tables))]
            for row, (case, part) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("_range").to_pylist())):
                if maps is None or case != at:
                    if maps is not None:
                        out.append((at, part, maps))
                    at, maps = case, [np.arange(len(t)) for t in tables]
                    if len(out) >= 8192:
                        yield flushed()
                        out = []
                maps = [t[m, s[row]] for t, m, s in zip(tables, maps, steps)]
        if maps is not None:
            out.append((at, part, maps))
        if out:
            yield flushed()

    parts = laid.mapInArrow(run, f"_key {key_type}, _range int, maps array<array<int>>")
    # As many entries per case as ranges hold its events.
    listed = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_range", "maps"))).alias("steps"))

    def end_of(i: int) -> Column:
        return F.aggregate("steps", F.lit(0), lambda state, step: F.get(step["maps"][i], state))

    ends = []
    for i, (name, p) in enumerate(patterns.items()):
        end = end_of(i)
        ends.append(F.struct(F.lit(name).alias("pattern"), (~end.isin(*sorted(p.good))).alias("broken")))
    return listed.select(F.col("_key").alias(key), F.explode(F.array(*ends)).alias("e")).select(key, "e.pattern", "e.broken")
