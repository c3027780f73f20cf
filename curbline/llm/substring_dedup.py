"""Removal of token windows that an earlier document has: Rabin-Karp hashes counted in Spark.

Tokens are words; a window is ``window`` consecutive words of one document. A word goes if a
window over it occurs in a document with a smaller id. All windows are judged on the input.

1. Tasks group each document's windows to runs by anchors (see ``anchors``) and send one narrow
   row per run. Spark counts anchors; runs whose anchor no other document has are settled.
2. A run that an earlier document has too is gone as a whole, whatever else its anchor has.
   The first owner of a run goes on only if its anchor has different runs: any earlier owner of
   a window owns it in a run that is first there.
3. The windows of those runs get two Rabin-Karp hashes modulo 2**61 - 1, which Spark counts.
4. Repeated windows merge into maximal intervals per document, and their words are removed.

Words are known by 128 bits of XXH3, runs by 128 bits over those, and windows by two Rabin-Karp
hashes, one over each half. Seed and bases are drawn anew for every job, so no text can
be built to collide. Counting combines map-side and the joins back are plain
equi-joins that Spark can split under skew, so a passage in a third of all documents is
spread. Texts move once, those with single windows to decide a second time.

Defined results: NULL and empty texts have no words; texts shorter than a window keep all
words; rows with NULL id keep all words and take none from others; rows with equal ids do not
take from each other and are told apart by a checksum of their text; equal rows each get a
result; other columns are ignored. ids are integers.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import drawn_seed, runs
from .buffers import BASES, PRIME, RabinKarp, blocks_of, digests, words_of
from .common import stored

GRAM = 8
RUN = "id long, version long, first int, count int, anchor long, w1 long, w2 long"


def _words(data: np.ndarray, ends: np.ndarray, seed: int):
    """(starts, stops, first, hashes) of the words of a block; two hashes each."""
    starts, stops, first = words_of(data, ends)
    return starts, stops, first, digests(data, starts, stops, seed)


def _versions(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    begins = np.concatenate(([0], ends[:-1]))
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(begins, ends, strict=True)], np.int64)


def window_runs(docs: DataFrame, window: int, gram: int, seed: int) -> DataFrame:
    """One row per run of windows; ``first`` counts words within the document."""

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, "text"):
                _, _, first, hashes = _words(data, ends, seed)
                text, place, count, anchor, _ = runs(hashes[:, 0], first, window, gram, BASES[1])
                whole = digests(hashes.view(np.uint8).ravel(), 16 * place, 16 * (place + count - 1 + window), seed).view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(text)),
                        pa.array(_versions(data, ends)[text]),
                        pa.array((place - first[text]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(np.ascontiguousarray(whole[:, 0])),
                        pa.array(np.ascontiguousarray(whole[:, 1])),
                    ],
                    ["id", "version", "first", "count", "anchor", "w1", "w2"],
                )

    return docs.where("id is not null").mapInArrow(run, RUN)


def undecided_runs(found: DataFrame) -> DataFrame:
    """(id, version, runs): runs that go whole (``gone``), and those whose windows must be counted."""
    one = [F.min(c) == F.max(c) for c in ("w1", "w2")]
    anchors = (
        found.groupBy("anchor")
        .agg(F.min("id").alias("least"), F.max("id").alias("most"), (one[0] & one[1]).alias("equal"))
        .where("least < most")
        .select("anchor", "equal")
    )
    open_ = stored(found.join(anchors, "anchor"), "repeated-runs")
    firsts = open_.groupBy("anchor", "w1", "w2").agg(F.min("id").alias("owner"))
    judged = open_.join(firsts, ["anchor", "w1", "w2"]).where("id > owner or not equal")
    runs = F.collect_list(F.struct("first", "count", (F.col("id") > F.col("owner")).alias("gone")))
    return judged.groupBy("id", "version").agg(runs.alias("runs"))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie under a window of ``length`` that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step)[:n] > 0


def _starts(found) -> np.ndarray:
    """Window starts of runs given as structs."""
    return np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in found]) if found else np.zeros(0, np.int64)


SETTLED = "id long, version long, n_words long, gone array<int>, kept string, text string, windows array<struct<h1:long,h2:long,at:int>>"


def _settle(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Results of documents without open windows; text and window hashes of the others."""
    bases = [(seed >> shift) % (PRIME - 1000) + 500 for shift in (0, 3)]

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, "text"):
                found = part.column("runs").to_pylist()
                open_texts = any(not r["gone"] for own in found for r in own or ())
                starts, stops, first = words_of(data, ends)
                hashes = digests(data, starts, stops, seed) if open_texts else None
                versions = _versions(data, ends).tolist()
                texts = part.column("text")
                rows = []
                for d, i in enumerate(part.column("id").to_pylist()):
                    a, b = int(first[d]), int(first[d + 1])
                    own = found[d] or []
                    gone = _starts([r for r in own if r["gone"]])
                    open_ = _starts([r for r in own if not r["gone"]])
                    if len(open_):
                        h1, h2 = (RabinKarp(hashes[a:b, k], base).ranges(open_, open_ + window).tolist() for k, base in enumerate(bases))
                        listed = [{"h1": x, "h2": y, "at": z} for x, y, z in zip(h1, h2, open_.tolist(), strict=True)]
                        rows.append((i, versions[d], b - a, gone.tolist(), None, texts[d].as_py(), listed))
                    else:
                        left = ~covered(gone, window, b - a)
                        kept = " ".join(_slices(data, starts[a:b][left], stops[a:b][left]))
                        rows.append((i, versions[d], b - a, gone.tolist(), kept, None, []))
                yield from _batches(rows)

    return docs.mapInArrow(run, SETTLED)


def _slices(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[str]:
    whole = data.tobytes()
    return [whole[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _batches(rows):
    kinds = [
        pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(),
        pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())])),
    ]
    names = ["id", "version", "n_words", "gone", "kept", "text", "windows"]
    for at in range(0, len(rows), 512):
        columns = zip(*rows[at : at + 512], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _finish(rows: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of documents whose windows were counted."""

    def run(batches):
        for batch in batches:
            out = []
            for i, n, gone, text, hits in zip(*(batch.column(c).to_pylist() for c in ("id", "n_words", "gone", "text", "hits")), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                starts, stops, _ = words_of(data, np.array([len(data)]))
                left = ~covered(np.array([*gone, *(hits or [])], np.int64), window, n)
                out.append((i, n, int(n - left.sum()), " ".join(_slices(data, starts[left], stops[left]))))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    ["id", "n_words", "n_removed", "kept"],
                )

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_removed, kept): the words left of every document, joined by spaces."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    seed = drawn_seed()
    found = undecided_runs(window_runs(rows, window, min(gram, window), seed))
    versioned = rows.withColumn("version", F.crc32(F.col("text").cast("binary")))
    settled = stored(_settle(versioned.join(found, ["id", "version"], "left").select("id", "text", "runs"), window, seed), "substring")
    windows = settled.where("kept is null").select("id", "version", F.explode("windows").alias("w")).select("id", "version", "w.h1", "w.h2", "w.at")
    firsts = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h1", "h2", "least")
    hits = windows.join(firsts, ["h1", "h2"]).where("id > least").groupBy("id", "version").agg(F.collect_set("at").alias("hits"))
    counted = _finish(settled.where("kept is null").join(hits, ["id", "version"], "left").select("id", "n_words", "gone", "text", "hits"), window)
    plain = settled.where("kept is not null").select("id", "n_words", _n_removed("gone", window), "kept")
    return plain.unionByName(counted).select(F.col("id").alias(key), "n_words", "n_removed", "kept")


def _n_removed(starts: str, window: int):
    """Words under windows of the given starts: each adds what reaches beyond the one before."""
    ordered = F.array_sort(starts)
    before = F.concat(F.array(F.lit(-window)), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))))
    gains = F.zip_with(ordered, before, lambda a, b: F.least(a - b, F.lit(window)))
    total = F.aggregate(gains, F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))
    return F.when(F.size(starts) > 0, total).otherwise(F.lit(0).cast("long")).alias("n_removed")
