"""Reports of one kind at one place as incidents: keyed state with event-time timers.

Reports of a key (a place cell and a type, say) whose times lie at most ``gap`` apart belong to one
incident. A key's state holds its open incidents only - three numbers each, whatever the number of
reports. A timer closes an incident once the watermark has passed its end by ``gap``: no report that
still counts can join it then, and its state is gone. Files may come in any order within ``delay``;
later rows are dropped, as the watermark tells.

Each batch writes, for every key that it touched, its closed incidents and those still open, so the
latest batch of a key tells what is open: see ``current_incidents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .jobs import BATCH, _write, run_available

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = StructType([StructField(c, LongType()) for c in ("first", "last", "n")])


def joined(spans: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, n) spans in order, with those at most ``gap`` apart made one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Incidents(StatefulProcessor):
    """Times are milliseconds since the epoch."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", STATE)

    def _keep(self, key, spans, closed):
        import pandas as pd

        if spans:
            self.open.put([tuple(s) for s in spans])
            for _, last, _ in spans:
                self.handle.registerTimer(last + self.gap + 1)
        else:
            self.open.clear()
        rows = [(*key, "closed", *s) for s in closed] + [(*key, "open", *s) for s in spans]
        names = [*(f"key{i}" for i in range(len(key))), "state", "first", "last", "n"]
        return pd.DataFrame(rows, columns=names)

    def _held(self):
        return [tuple(int(x) for x in s) for s in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        late = timerValues.getCurrentWatermarkInMs()
        new = [(int(t), int(t), 1) for part in rows for t in part["ms"].tolist() if t >= late]
        if new:
            yield self._keep(key, joined(self._held() + new, self.gap), [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        closed = [s for s in held if s[1] + self.gap < passed]
        if closed:
            yield self._keep(key, [s for s in held if s[1] + self.gap >= passed], closed)

    def close(self) -> None:
        pass


def stream_incidents(
    stream: DataFrame, keys: list[str], ts: str, gap_ms: int, delay: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Write the incidents of each batch below ``target``. Rows without a time or a key value are left out.

    ``keys`` are string columns. Needs the RocksDB state store, which this sets for the session.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    usable = F.col(ts).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    rows = (
        stream.filter(usable)
        .select(*[F.col(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)], F.col(ts).cast("timestamp").alias("at"))
        .withWatermark("at", delay)
        .withColumn("ms", F.unix_millis("at"))
    )
    shape = StructType(
        [StructField(f"key{i}", StringType()) for i in range(len(keys))]
        + [StructField("state", StringType())]
        + [StructField(c, LongType()) for c in ("first", "last", "n")]
    )
    told = rows.groupBy(*[f"key{i}" for i in range(len(keys))]).transformWithStateInPandas(
        statefulProcessor=Incidents(gap_ms), outputStructType=shape, outputMode="Update", timeMode="EventTime"
    )
    named = told.withColumnsRenamed({f"key{i}": k for i, k in enumerate(keys)})
    return run_available(named, lambda batch, number: _write(batch, target, number), checkpoint, "update")


def current_incidents(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """keys, first, last, n: all closed incidents, and those that were open when the key was last touched."""
    log = spark.read.parquet(target)
    latest = F.max(BATCH).over(W.partitionBy(*keys))
    standing = log.withColumn("_latest", latest).filter((F.col("state") == "closed") | (F.col(BATCH) == F.col("_latest")))
    return standing.select(*keys, *[F.timestamp_millis(c).alias(c) for c in ("first", "last")], "n")
