"""Exact duplicates through an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normal form (A-Z in lower case). The directory maps
key prefixes to buckets. It starts with one bucket; an overfull bucket (more bytes of
distinct texts than ``capacity``) splits by its next bit, and the directory doubles where
that needs a longer prefix. The driver holds one directory row per bucket, so ``capacity`` should
grow with corpora of many terabytes. Sizes come from counts by prefix, for overfull buckets only and at most
``FETCHED`` (or two per overfull bucket) in a round, so the driver sees numbers of prefixes, never keys of documents.

Each bucket, a key range, has one owner task. Owners read their range in key order and hold
one collision chain at a time: texts with equal keys are told apart by comparing bytes.
Copies are combined in every task before the shuffle, in stretches of up to ``COMBINED`` bytes of
distinct texts, so a text that a third of all rows repeat reaches its owner once per stretch. The index stores every distinct text, so
``extend`` can add documents: only buckets that get entries or split are written anew.

Documents find their entry again by SHA-256 in a join that Spark can split under skew; the
owners raise if two different texts ever share a digest.

Defined results: NULL counts as empty; NULL keys are smaller than any other key and a group
of NULL keys only keeps NULL; of rows with equal text and equal largest key every one counts
as kept; rows with equal keys and other texts are judged by their own texts; an empty table gives no
rows; other columns are ignored. ``deduplicate`` keeps the rows that count as kept.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buffers import blocks_of, folded
from .common import UPPER, fresh, opened, shared_folder

#: Most bits by which one round of counts looks further into the keys, and counts it may fetch.
STEP = 12
FETCHED = 1 << 16
#: Bytes of distinct texts that a task combines before it sends them.
COMBINED = 32 << 20
ENTRY = "bucket long, key long, sha binary, keep long, n long, text binary"


@dataclass
class Index:
    """Where the entries are; ``directory`` rows: first key, local depth, generation folder."""

    folder: str
    directory: list[tuple[int, int, str]]

    @property
    def global_depth(self) -> int:
        return max(depth for _, depth, _ in self.directory)

    def save(self) -> None:
        fs, where = opened(f"{self.folder}/directory.json")
        with fs.open_output_stream(where) as out:
            out.write(json.dumps(self.directory).encode())


def load(folder: str) -> Index:
    fs, where = opened(f"{folder}/directory.json")
    with fs.open_input_stream(where) as file:
        return Index(folder, [tuple(row) for row in json.loads(file.read())])


def normal_texts(batch: pa.RecordBatch, text: str):
    """(rows, list of normal forms as bytes) in blocks."""
    for part, data, ends in blocks_of(batch, text):
        whole = folded(data).tobytes()
        yield part, [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _keys(texts: list[bytes]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(t) for t in texts]


def sizes_by_key(docs: DataFrame, text: str) -> DataFrame:
    """(key, bytes): one row per distinct key."""

    def run(batches):
        for batch in batches:
            for _, texts in normal_texts(batch, text):
                keys = np.array(_keys(texts), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(map(len, texts)), pa.int64())], ["key", "bytes"])

    return docs.select(text).mapInArrow(run, "key long, bytes long").groupBy("key").agg(F.max("bytes").alias("bytes"))


def split_directory(sizes: DataFrame, capacity: int, start: list[tuple[int, int]] = ((0, 0),)) -> list[tuple[int, int]]:
    """(first key, depth) of buckets that hold at most ``capacity`` bytes, or a single prefix of all bits.

    Each round counts bytes by longer prefixes of the buckets that are still overfull, and
    splits them bit by bit on those counts. The more are overfull, the shorter the step.
    """
    done, open_ = [], [(first, depth) for first, depth in start]
    while open_:
        step = max(1, min(STEP, (FETCHED // len(open_)).bit_length() - 1))
        depth = min(max(d for _, d in open_) + step, 63)
        prefix = F.shiftrightunsigned("key", 64 - depth)
        rows = sizes
        if open_ != [(0, 0)]:  # leave out what is settled
            kept = None
            for d in sorted({d for _, d in open_}):
                inside = sizes
                if d:
                    own = sizes.sparkSession.createDataFrame([(first >> (64 - d),) for first, e in open_ if e == d], "inside long")
                    inside = sizes.join(F.broadcast(own), F.shiftrightunsigned("key", 64 - d) == F.col("inside"), "left_semi")
                kept = inside if kept is None else kept.unionByName(inside)
            rows = kept
        counts = {r["p"]: r["b"] for r in rows.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("b")).collect()}
        prefixes = np.array(sorted(counts), np.uint64)
        sums = np.concatenate(([0], np.cumsum([counts[int(p)] for p in prefixes])))
        still, todo = [], list(open_)
        while todo:
            first, d = todo.pop()
            low = first >> (64 - depth)
            a, b = np.searchsorted(prefixes, np.array([low, low + (1 << (depth - d))], np.uint64))
            if sums[b] - sums[a] <= capacity:
                done.append((first, d))
            elif d < depth:
                todo += [(first, d + 1), (first + (1 << (63 - d)), d + 1)]
            elif depth < 63:
                still.append((first, d))
            else:
                done.append((first, d))
        open_ = still
    return sorted(done)


def _combined(docs: DataFrame, directory: list[tuple[int, int]], key: str, text: str) -> DataFrame:
    """Entries with their bucket, copies within a block already one row."""
    starts = np.array([first for first, _ in directory], np.uint64)

    def sent(found):
        keys = np.array(_keys(list(found)), np.uint64)
        bucket = starts[np.searchsorted(starts, keys, side="right") - 1]
        columns = [
            pa.array(bucket.view(np.int64)),
            pa.array(keys.view(np.int64)),
            pa.array([None] * len(found), pa.binary()),
            pa.array([v[0] for v in found.values()], pa.int64()),
            pa.array([v[1] for v in found.values()], pa.int64()),
            pa.array(list(found), pa.binary()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["bucket", "key", "sha", "keep", "n", "text"])
        for at in range(0, len(found), 1024):
            yield whole.slice(at, 1024)

    def run(batches):
        found: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for part, texts in normal_texts(batch, text):
                for t, i in zip(texts, part.column(key).to_pylist(), strict=True):
                    have = found.get(t)
                    if have is None:
                        found[t] = [i, 1]
                        size += len(t) + 100
                        continue
                    have[0] = i if have[0] is None or (i is not None and i > have[0]) else have[0]
                    have[1] += 1
                if size > COMBINED:
                    yield from sent(found)
                    found, size = {}, 0
        if found:
            yield from sent(found)

    return docs.select(key, text).mapInArrow(run, ENTRY)


def _own(batches):
    """Owner: rows come ordered by bucket and key; one chain is held at a time."""
    names = ["bucket", "key", "sha", "keep", "n", "text"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    out, size = [], 0
    at, chain = None, []

    def closed():
        digests = [hashlib.sha256(link[0]).digest() for link in chain]
        if len(set(digests)) < len(digests):
            raise ValueError("two different texts share a SHA-256 digest")
        return [(*at, d, keep, n, t) for d, (t, keep, n) in zip(digests, chain, strict=True)]

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for bucket, key, keep, n, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "keep", "n", "text")), strict=True):
            if (bucket, key) != at:
                if chain:
                    out += closed()
                    size += sum(len(link[0]) for link in chain)
                at, chain = (bucket, key), []
                if size > 1 << 22 or len(out) > 4096:
                    yield flushed()
                    out, size = [], 0
            for link in chain:  # equal keys: compare bytes along the chain
                if link[0] == text:
                    link[1] = keep if link[1] is None or (keep is not None and keep > link[1]) else link[1]
                    link[2] += n
                    break
            else:
                chain.append([text, keep, n])
    if chain:
        out += closed()
    if out:
        yield flushed()


def _owned(entries: DataFrame) -> DataFrame:
    return entries.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_own, ENTRY)


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", capacity: int = 32 << 20) -> Index:
    """Index all documents below ``folder``."""
    directory = split_directory(sizes_by_key(docs, text), capacity)
    generation = f"{folder}/generation-0"
    _owned(_combined(docs, directory, key, text)).write.parquet(generation)
    index = Index(folder, [(first, depth, generation) for first, depth in directory])
    index.save()
    return index


def entries(spark: SparkSession, index: Index) -> DataFrame:
    """(bucket, key, sha, keep, n, text) of all distinct texts."""
    out = None
    for generation in sorted({g for _, _, g in index.directory}):
        own = [(first - (1 << 64) if first >> 63 else first,) for first, _, g in index.directory if g == generation]
        rows = spark.read.schema(ENTRY).parquet(generation).join(spark.createDataFrame(own, "bucket long"), "bucket", "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out


def extend(spark: SparkSession, index: Index, docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 32 << 20) -> Index:
    """Add documents; writes a new generation of the buckets that change."""
    old = entries(spark, index)
    sizes = old.select("key", F.octet_length("text").cast("long").alias("bytes")).unionByName(sizes_by_key(docs, text))
    sizes = sizes.groupBy("key").agg(F.max("bytes").alias("bytes"))
    directory = split_directory(sizes, capacity, [(first, depth) for first, depth, _ in index.directory])
    new = _combined(docs, directory, key, text)
    before = {(first, depth): g for first, depth, g in index.directory}
    hit = {r["bucket"] % (1 << 64) for r in new.select("bucket").distinct().collect()}
    changed = [(first, depth) for first, depth in directory if first in hit or (first, depth) not in before]
    generation = f"{index.folder}/generation-{len({g for _, _, g in index.directory})}"
    starts = np.array([first for first, _ in directory], np.uint64)

    def placed(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            bucket = starts[np.searchsorted(starts, keys, side="right") - 1].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns[1:]], batch.schema.names)

    touched = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f, _ in changed], "bucket long")
    moved = old.mapInArrow(placed, ENTRY).join(touched, "bucket", "left_semi")
    _owned(moved.unionByName(new)).write.parquet(generation)
    index = Index(index.folder, [(f, d, generation if (f, d) in set(changed) else before[f, d]) for f, d in directory])
    index.save()
    return index


def groups(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every document, read from the index."""

    def digest(batches):
        for batch in batches:
            for part, texts in normal_texts(batch, text):
                sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), sha], ["id", "sha"])

    rows = docs.select(key, text).mapInArrow(digest, "id long, sha binary")
    found = entries(docs.sparkSession, index).select("sha", "keep", "n")
    return rows.join(found, "sha").select(
        F.col("id").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, with the columns it came with."""
    index = build(docs, shared_folder(docs.sparkSession, "exact"), key, text)
    gone, digest = fresh(docs, "gone"), fresh(docs, "digest")
    drop = groups(docs, index, key, text).where(~F.col("kept"))
    drop = drop.select(F.col(key).alias(gone), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()).cast("binary"), 256)
    return docs.join(drop, F.col(key).eqNullSafe(F.col(gone)) & (own == F.col(digest)), "left_anti")
