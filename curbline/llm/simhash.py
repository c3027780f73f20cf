"""Near-duplicate groups by SimHash: covering locality-sensitive hashing, exact within the radius.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 hashes of a
text's shingles, repeats counted. Fingerprints that differ in at most ``radius`` bits link.

1. Tasks compute fingerprints; equal ones are one node, its smallest id stands for it.
2. Covering tables. Bit i belongs to one of the non-zero vectors of radius + 1 bits; table v
   keeps the bits whose vector has an odd product with v. ``radius`` vectors always have a
   non-zero v orthogonal to them all, so every pair within the radius agrees in the whole key
   of some table: no pair is missed. Keys that only one fingerprint has go.
3. Fingerprints of one key differ in the bits that the table leaves out only. Two of them are
   within the radius if and only if balls of half the radius around them meet. So each sends
   the centres of its ball to Spark, and what meets at a centre links to the least of it. A
   centre holds at most one ball of fingerprints (65 for radius 2), so nothing is compared in
   pairs and no key, however hot, is collected: a full bucket costs a row per centre.
4. Components of the links.

Cost: 2**(radius + 1) - 1 narrow rows per fingerprint for step 2, and about half of 64 over
half the radius per fingerprint and key that has company. Meant for radii up to 4.

Defined results: NULL and empty texts and texts without words have fingerprint zero and link
like any other; fewer words than ``size`` make one shingle of them all; rows with NULL id get
a fingerprint, no component, and link with nothing; rows with equal ids are one document that
has all their links; other columns are ignored; an empty table gives none. ids are integers.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import blocks_of, folded, spaced, words_of
from .common import stored
from .components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once (64 bytes each).
COUNTED = 1 << 16


def shingle_hashes(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle: words joined by one space, A-Z in lower case."""
    import xxhash

    starts, stops, first = words_of(data, ends)
    plain, starts, stops = spaced(folded(data), starts, stops)
    raw, h = plain.tobytes(), xxhash.xxh64_intdigest
    words = np.diff(first)
    text = np.repeat(np.arange(len(ends)), words)
    place = np.arange(len(text))
    last = first[1:][text]
    head = np.flatnonzero((place + size <= last) | ((place == first[:-1][text]) & (words[text] < size)))
    tail = np.minimum(head + size, last[head]) - 1
    every = (h(raw[a:b], SEED) for a, b in zip(starts[head].tolist(), stops[tail].tolist(), strict=True))
    return text[head], np.fromiter(every, np.uint64, len(head))


def majority(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the bits that over half of its hashes have; 0 without any."""
    counts = np.zeros((n, BITS), np.int64)
    for at in range(0, len(hashes), COUNTED):
        own = text[at : at + COUNTED]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        bits = np.unpackbits(hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    total = np.bincount(text, minlength=n)
    return np.packbits(2 * counts > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row; the fingerprint as a signed integer of 64 bits."""

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, "text"):
                own = majority(*shingle_hashes(data, ends, size), len(ends))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks of 64 bits; any two integers that differ in up to ``radius`` bits agree under one of them."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(mask: int, radius: int) -> list[int]:
    """All changes of up to ``radius`` of the bits that ``mask`` leaves out."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [_signed(sum(c)) for k in range(radius + 1) for c in combinations(free, k)]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect all nodes (rep, fp) whose distinct fingerprints are within the radius."""
    if radius == 0:
        return nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    masks = covering_masks(radius)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    tables = nodes.select("rep", "fp", keys.alias("k")).select("rep", "fp", "k.table", "k.key")
    full = tables.groupBy("table", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    near = tables.join(full.select("table", "key"), ["table", "key"], "left_semi")
    # Balls of half the radius; for an odd one, one side's ball is larger by a bit.
    small, large = radius // 2, (radius + 1) // 2
    balls = F.element_at(F.array(*[F.array(*map(F.lit, _ball(m, large))) for m in masks]), F.col("table") + 1)
    centres = near.select("rep", "fp", F.explode(balls).alias("change")).select(
        F.col("fp").bitwiseXOR(F.col("change")).alias("centre"), F.struct((F.bit_count("change") > small).alias("far"), "rep").alias("member")
    )
    met = centres.groupBy("centre").agg(F.collect_set("member").alias("members")).where("size(members) > 1")
    least = met.select(F.array_min("members").alias("least"), F.explode("members").alias("member")).where("not least.far")
    return least.select(F.col("member.rep").alias("a"), F.col("least.rep").alias("b")).where("a <> b")


def _repeated(rows: DataFrame) -> DataFrame:
    """(again): ids of more than one row."""
    return rows.groupBy(F.col("id").alias("again")).count().where("count > 1").select("again")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """(key, fingerprint, component_id) of every row; 16 lowercase hex digits, smallest id reachable."""
    found = stored(fingerprints(docs, key, text, size), "fingerprints")
    known = found.where("id is not null")
    nodes = stored(known.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    edges = links(nodes, radius)
    # Rows of one id are one document: its fingerprints hang together.
    owned = known.join(nodes, "fp").select("id", F.col("rep").alias("b")).where("id <> b")
    edges = edges.unionByName(owned.select(F.col("id").alias("a"), "b").join(_repeated(known), F.col("a") == F.col("again"), "left_semi"))
    roots = nodes.join(components(edges), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return found.join(roots, "fp", "left").select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )
