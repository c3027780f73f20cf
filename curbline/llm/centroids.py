"""Centroid clustering of integer vectors over subvector dictionaries, exact in every round.

Vectors are cut into blocks of dimensions, and each block is dictionary-encoded without loss:
a chunk of vectors holds the distinct subvectors of the block once and a code per vector. In a
round the distances of the distinct subvectors to all centroids are computed once, and a
vector's distance is the sum of those its codes name. Sums of the members come from the
dictionaries as well, weighted by how often each cluster uses a code.

1. Tasks encode chunks of up to ``CHUNK`` vectors of whole partitions, without a shuffle. Blocks
   start as single dimensions; neighbours merge where the merged dictionary costs less to
   compare than two lookups, so copies of whole vectors end as one entry.
2. Every round is one pass over the encoded table. A task returns one row of exact sums per
   cluster, Spark adds them up, and only k centroids come to the driver.
3. After the last round one more pass assigns the vectors.

Integers throughout: components are floor(``scale`` * x), distances squared, means rounded down.

Defined results: vectors that are NULL, have another number of components than ``dims`` or any
NULL or non-finite one take no part; NULL keys take part, but never start a centroid; repeated rows are
vectors like others (equal keys start centroids in the order of their components); equal
distances go to the smaller number; a cluster without members keeps its centroid; fewer
vectors than k give as many centroids; an empty table gives an empty result; other columns
are ignored. A component beyond 2**27 in size raises, since distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK = 16384
LARGEST = 1 << 27
ENCODED = "ids array<long>, widths array<int>, dictionaries array<binary>, codes array<binary>"
SUMS = "cluster int, members long, sums array<long>"


def integers(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the usable vectors as arrays of integers."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fits = F.forall(whole, lambda c: F.abs(c) <= LARGEST)
    rows = vectors.where((F.size(x) == dims) & sound).select(F.col(key).cast("long").alias("id"), whole.alias("v"), fits.alias("fits"))
    return rows.select("id", F.when(F.col("fits"), F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}"))).alias("v"))


def blocks(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dictionary, codes) of consecutive blocks of columns; a dictionary's rows are distinct."""
    n = len(matrix)
    level = []
    for c in range(matrix.shape[1]):
        known, codes = np.unique(matrix[:, c], return_inverse=True)
        level.append((known[:, None], codes))
    merged = True
    while merged and len(level) > 1:
        merged, out, at = False, [], 0
        while at < len(level):
            if at + 1 < len(level):
                (a, x), (b, y) = level[at], level[at + 1]
                both, codes = np.unique(x * len(b) + y, return_inverse=True)
                # Comparing subvectors against looking up once more for every vector.
                if len(both) * (a.shape[1] + b.shape[1]) <= len(a) * a.shape[1] + len(b) * b.shape[1] + n:
                    out.append((np.hstack([a[both // len(b)], b[both % len(b)]]), codes))
                    merged, at = True, at + 2
                    continue
            out.append(level[at])
            at += 1
        level = out
    return level


def _chunk_row(ids: list, matrix: np.ndarray) -> pa.RecordBatch:
    parts = blocks(matrix)
    columns = [
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([[d.shape[1] for d, _ in parts]], pa.list_(pa.int32())),
        pa.array([[d.astype("<i4").tobytes() for d, _ in parts]], pa.list_(pa.binary())),
        pa.array([[c.astype("<u2").tobytes() for _, c in parts]], pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["ids", "widths", "dictionaries", "codes"])


def encode(vectors: DataFrame, dims: int) -> DataFrame:
    """The vectors (id, v) as dictionary-encoded chunks, one row each."""

    def run(batches):
        ids, parts, held = [], [], 0
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            names, at = batch.column("id").to_pylist(), 0
            while at < len(names):
                to = min(len(names), at + CHUNK - held)
                ids += names[at:to]
                parts.append(values[at:to])
                held, at = held + to - at, to
                if held == CHUNK:
                    yield _chunk_row(ids, np.concatenate(parts))
                    ids, parts, held = [], [], 0
        if held:
            yield _chunk_row(ids, np.concatenate(parts))

    return vectors.mapInArrow(run, ENCODED)


def _assigned(batches, centroids: np.ndarray):
    """(ids, blocks, cluster, distance) of one chunk after the other."""
    k = len(centroids)
    for batch in batches:
        for ids, widths, dictionaries, codes in zip(*(batch.column(c) for c in ("ids", "widths", "dictionaries", "codes")), strict=True):
            total = np.zeros((len(ids), k), np.int64)
            parts, column = [], 0
            for w, known, code in zip(widths.as_py(), dictionaries, codes, strict=True):
                known = np.frombuffer(known.as_buffer(), "<i4").reshape(-1, w).astype(np.int64)
                code = np.frombuffer(code.as_buffer(), "<u2")
                own = centroids[:, column : column + w]
                partial = np.stack([((known - c) ** 2).sum(axis=1) for c in own], axis=1)
                total += partial[code]
                parts.append((known, code))
                column += w
            cluster = total.argmin(axis=1)  # the first of equal ones
            yield ids, parts, cluster, total[np.arange(len(total)), cluster]


def _sums(encoded: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (members, sum of each component)} of the nearest centroids."""
    k, dims = centroids.shape

    def run(batches):
        members, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, parts, cluster, _ in _assigned(batches, centroids):
            members += np.bincount(cluster, minlength=k)
            column = 0
            for known, code in parts:
                uses = np.bincount(cluster * len(known) + code, minlength=k * len(known)).reshape(k, -1)
                sums[:, column : column + known.shape[1]] += uses @ known
                column += known.shape[1]
        used = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(members[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "members", "sums"]
        )

    each = encoded.mapInArrow(run, SUMS).select("cluster", "members", F.posexplode("sums").alias("at", "x"))
    rows = each.groupBy("cluster", "at").agg(F.sum("members").alias("members"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
    found = {}
    for r in rows.collect():  # k rows for each component
        found.setdefault(r.cluster, (r.members, [0] * dims))[1][r["at"]] = int(r.total)
    return found


def _assign(encoded: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches):
        for ids, _, cluster, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return encoded.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors (id, v) with the smallest SHA-256 of ``salt`` and their key."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").orderBy(digest, "id", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:"
) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every usable vector, the final centroids)."""
    whole = integers(vectors, key, vector, dims, scale)
    centroids = first_centroids(whole, k, salt).reshape(-1, dims)
    if not len(centroids):
        return whole.limit(0).select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    encoded = stored(encode(whole, dims), "encoded-vectors")
    for _ in range(rounds):
        found = _sums(encoded, centroids)
        for c, (members, sums) in found.items():
            centroids[c] = [s // members for s in sums]
    return _assign(encoded, centroids).withColumnRenamed("id", key), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with the distance sums of its cluster and of all, and the centroid's digest."""
    rows = stored(assigned, "assigned")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(r["cluster_inertia"] for r in sums)
    facts = [(r["cluster"], r["cluster_inertia"], total, digests[r["cluster"]]) for r in sums]
    described = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(described), "cluster").select(*[c for c in rows.columns], "cluster_inertia", "inertia", "centroid_sha256")
