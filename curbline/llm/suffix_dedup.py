"""Removal of every long byte string that occurs twice: prefix doubling on thinned positions.

A byte goes if some string of ``window`` bytes over it also starts at another place, in the
same or another document. Doubling over every position would sort 16 bytes per byte of
text and round, so positions are thinned without loss first:

1. The anchor of a window is its least gram (see ``anchors``). Windows whose anchor gram is
   unique in the corpus are unique and settled.
2. Windows with the same anchor form runs. Equal runs settle as repeated; each distinct run
   of an anchor that has several goes on once, as a string.
3. Equal windows lie equally about their anchors. So only the places at multiples of ``step`` bytes from
   the anchor are ranked. Prefix doubling in Spark: the first rank is the place of the first
   ``2 * step`` bytes among the sorted distinct ones; every round pairs the ranks of places at a growing
   offset, sorts the distinct pairs and reranks. A pair that occurs once is unique and falls out. Ranks of
   a string's places are one row, so pairs are formed inside of rows.
4. When ranks cover the window but for less than ``2 * step`` bytes, these bytes decide: windows are equal
   if and only if rank and the bytes on both sides are. That is asked for all windows of a step at
   once first, and window by window only where their ends differ.
5. Repeated windows merge to maximal intervals per document.

Ranks are exact. Runs are compared by 128 bits of XXH3 with a seed that is drawn anew for every job; anchors only
group. Each step is written to the shared folder, counts combine before they shuffle, and joins are plain equi-joins
that Spark can split under skew: an anchor in a third of all documents is no group in any task.

Defined results: NULL and empty texts and texts shorter than a window keep everything;
rows with equal id and text are documents that repeat each other; rows with equal id and
other text are told apart by a checksum; NULL ids are documents like others; other columns
are ignored. ids are integers above the least one of 64 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import drawn_seed, runs
from .buffers import BASES, blocks_of, digests
from .common import stored

GRAM = 64
STEP = 16
NULL_ID = -(1 << 63)
RUN = "id long, version long, first int, count int, at int, anchor long, w1 long, w2 long"
WHOLE = ["anchor", "w1", "w2"]


def byte_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per run of windows; ``first`` counts bytes within the document, ``at`` from there to the anchor."""
    seed = drawn_seed()

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, "text"):
                bounds, raw = np.concatenate(([0], ends)), data.tobytes()
                text, place, count, anchor, at = runs(data, bounds, window, gram, BASES[0])
                whole = digests(data, place, place + count - 1 + window, seed).view("<i8")
                versions = np.array([zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), ends.tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(text)),
                        pa.array(versions[text]),
                        pa.array((place - bounds[text]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array((at - place).astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(np.ascontiguousarray(whole[:, 0])),
                        pa.array(np.ascontiguousarray(whole[:, 1])),
                    ],
                    ["id", "version", "first", "count", "at", "anchor", "w1", "w2"],
                )

    return docs.mapInArrow(run, RUN)


STRING = "string_id long, id long, version long, first int, count int, phase int, copies long, string binary"


def _strings(docs: DataFrame, window: int, step: int) -> DataFrame:
    """The bytes under the wanted runs of each document; ``phase`` is the first ranked place."""
    names = [c.split()[0] for c in STRING.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def flushed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        from pyspark import TaskContext

        number, rows = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            for i, version, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "version", "text", "wanted")), strict=True):
                data = text.encode()
                for w in wanted:
                    string = data[w["first"] : w["first"] + w["count"] - 1 + window]
                    rows.append((number, i, version, w["first"], w["count"], w["at"] % step, w["copies"], string))
                    number += 1
                    if len(rows) == 8192:
                        yield flushed(rows)
                        rows = []
        if rows:
            yield flushed(rows)

    return docs.mapInArrow(run, STRING)


def _reranked(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(string_id, ranks): new ranks of the cells (string_id, place, *keys) whose keys occur more than once, by place."""
    names = cells.groupBy(*keys).count().where("count > 1").select(*keys)
    names = names.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    known = cells.join(stored(names, "ranks"), keys).select("string_id", F.struct("place", "rank").alias("r"))
    return stored(known.groupBy("string_id").agg(F.map_from_entries(F.collect_list("r")).alias("ranks")), "ranked-strings")


def _part(start: Column, stop: Column) -> Column:
    """Bytes of the string from ``start`` up to ``stop``, counted from 0."""
    return F.substring(F.col("string"), start + 1, stop - start)


def repeated_windows(strings: DataFrame, window: int, step: int) -> DataFrame:
    """(id, version, first, count): windows of strings with one copy that another string has as well."""
    target = (window - step) // step * step  # bytes that ranks cover in the end
    length = min(2 * step, target)
    size, phase = F.length("string"), F.col("phase")
    places = F.sequence(F.lit(0), F.floor((size - phase - length) / step).cast("int"))
    here = strings.where(size - phase >= length).select("string_id", "string", "phase", F.explode(places).alias("place"))
    start = phase + F.col("place") * step
    ranks = _reranked(here.select("string_id", "place", _part(start, start + length).alias("key")), ["key"])
    while length < target:
        longer = min(2 * length, target)
        offset = (longer - length) // step
        pairs = F.transform(F.map_entries("ranks"), lambda e: F.struct(e["key"].alias("place"), e["value"].alias("a"), F.col("ranks")[e["key"] + offset].alias("b")))
        cells = ranks.select("string_id", F.explode(F.filter(pairs, lambda p: p["b"].isNotNull())).alias("p")).select("string_id", "p.*")
        ranks = _reranked(cells, ["a", "b"])
        length = longer
    # The windows that start less than a step before a place whose rank covers ``target`` bytes.
    held = strings.join(ranks, "string_id").select("string_id", "string", "phase", "count", F.explode("ranks").alias("place", "rank"))
    inner = F.col("phase") + F.col("place") * step
    low, high = F.greatest(inner - step + 1, F.lit(0)), F.least(inner, F.col("count") - 1)
    blocks = held.select("string_id", "string", "rank", inner.alias("inner"), low.alias("low"), high.alias("high")).where("low <= high")
    ends = [_part(F.col("low"), F.col("inner")).alias("left"), _part(F.col("inner") + target, F.col("high") + window).alias("right")]
    blocks = stored(blocks.select("string_id", "low", "high", "rank", (F.col("inner") - F.col("low")).alias("back"), *ends), "window-blocks")
    same = ["rank", "back", (F.col("high") - F.col("low")).alias("span"), "left", "right"]
    key = ["rank", "back", "span", "left", "right"]
    groups = blocks.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("string_id", "low")).alias("rep"))
    groups = stored(groups, "window-groups")
    whole = blocks.withColumn("span", same[2]).join(groups.where("n > 1").select(*key), key, "left_semi")
    whole = whole.select("string_id", F.col("low").alias("at"), (F.col("span") + 1).alias("n"))
    # Where a rank has blocks of several ends, one of each kind stands for its windows.
    several = groups.groupBy("rank").agg(F.count("*").alias("kinds")).where("kinds > 1").select("rank")
    each = groups.join(several, "rank", "left_semi").select("rank", "back", "left", "right", "n", "rep", F.explode(F.sequence(F.lit(0), F.col("span"))).alias("j"))
    # Bytes of window j before the ranked ones, and behind.
    before = F.col("left").substr(F.col("j") + 1, F.col("back") - F.col("j"))
    behind = F.col("right").substr(F.lit(1), F.col("j") - F.col("back") + (window - target))
    each = each.select("rank", (F.col("back") - F.col("j")).alias("ahead"), before.alias("before"), behind.alias("behind"), "n", "rep", "j")
    single = ["rank", "ahead", "before", "behind"]
    again = each.groupBy(*single).agg(F.sum("n").alias("all")).where("all > 1").select(*single)
    alone = each.where("n = 1").join(again, single, "left_semi")
    alone = alone.select("rep.string_id", (F.col("rep.low") + F.col("j")).alias("at"), F.lit(1).alias("n"))
    owners = strings.where("copies = 1").select("string_id", "id", "version", "first")
    found = whole.unionByName(alone).join(owners, "string_id")
    return found.select("id", "version", (F.col("first") + F.col("at")).alias("first"), F.col("n").cast("int").alias("count"))


def _finish(rows: DataFrame, window: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept)."""

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, "text"):
                begins = np.concatenate(([0], ends[:-1]))
                gone = part.column("gone")
                spans = gone.flatten()
                doc = np.repeat(np.arange(len(ends)), pa.compute.list_value_length(gone).fill_null(0).to_numpy())
                first = begins[doc] + spans.field("first").to_numpy()
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, first, 1)
                np.add.at(step, first + spans.field("count").to_numpy() - 1 + window, -1)
                lost = np.cumsum(step[:-1]) > 0
                rising = lost.copy()
                rising[1:] &= ~lost[:-1]
                inner = begins[(begins > 0) & (begins < len(data))]
                rising[inner] = lost[inner]  # a span ends with its document
                sums = (np.concatenate(([0], np.cumsum(x))) for x in (lost, rising))
                n_lost, n_spans = ((x[ends] - x[begins]).astype(np.int64) for x in sums)
                sizes = ends - begins
                bounds = np.concatenate(([0], np.cumsum(sizes - n_lost))).astype(np.int32)
                kept = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data[~lost])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), pa.array(n_lost), pa.array(n_spans), kept], ["id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): the bytes left of every document."""
    gram, step = min(gram, window), max(1, min(step, window // 2))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    versioned = rows.withColumn("version", F.crc32(F.col("text").cast("binary")))
    found = byte_runs(rows, window, gram)
    one = [F.min(c) == F.max(c) for c in ("w1", "w2")]
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), (one[0] & one[1]).alias("equal")).where("n > 1")
    anchors = stored(anchors.select("anchor", "equal"), "anchors")
    open_ = stored(found.join(anchors, "anchor"), "repeated-runs")
    distinct = open_.where("not equal").groupBy(*WHOLE).agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "version", "first", "count", "at")).alias("rep")
    )
    distinct = stored(distinct, "distinct-runs")
    # Runs with a copy are gone whole; those with one copy may share single windows.
    copied = open_.where("not equal").join(distinct.where("copies > 1").select(*WHOLE), WHOLE, "left_semi")
    wanted = distinct.select("rep.id", "rep.version", F.struct("rep.first", "rep.count", "rep.at", "copies").alias("w"))
    wanted = wanted.groupBy("id", "version").agg(F.collect_list("w").alias("wanted"))
    # Of repeated rows one gives the strings; all of them get the result.
    texts = versioned.join(wanted, ["id", "version"]).dropDuplicates(["id", "version"])
    spans = stored(repeated_windows(stored(_strings(texts, window, step), "strings"), window, step), "repeated-windows")
    span = ["id", "version", "first", "count"]
    gone = open_.where("equal").select(*span).unionByName(copied.select(*span)).unionByName(spans)
    per_doc = gone.groupBy("id", "version").agg(F.collect_list(F.struct("first", "count")).alias("gone"))
    out = _finish(versioned.join(per_doc, ["id", "version"], "left").select("id", "text", "gone"), window)
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
