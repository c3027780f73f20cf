"""Document quality by nearest-neighbour voting in a latent-semantic space.

A document is a vector of log counts of byte trigrams, hashed to ``features`` columns and
weighted by inverse document frequency, and of shape terms: how much it compresses, its
share of signs, of digits, and of words that repeat the word before, each as a scale of
steps. The vector is projected on the leading singular vectors of the labelled sample. Its score is the mean label of its ``k`` most similar labelled
vectors by cosine, weighted by similarity. The products are exact: every document against
every labelled vector, in blocks of 64-bit floats; nothing is approximated or skipped.
Similarities are compared after rounding to 2**-24, so that neither block sizes nor the
order of sums decide between neighbours.

The only bounded part is the sample of labelled rows (``sample`` rows with the smallest
hash of the key; a documented parameter of the fit). Model and vectors are of fixed size
(features x dims and sample x dims), so they go to every task. Every document is scored.

Defined results: a NULL or empty text, or one of fewer than three bytes, has a zero vector
and gets the share of label 1 in the sample; ties among neighbours go to the earlier sample
row; repeated rows each get a score; an empty label table gives 0.5 everywhere; labels that
are NULL, labels without a document and NULL keys are left out of the fit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import BASES, Rolling, blocks_of, words_of
from .common import smallest_hashes

MIX = np.uint32(0x9E3779B1)


@dataclass
class Model:
    """What scoring needs, of fixed size."""

    idf: np.ndarray  # features
    axes: np.ndarray  # features x dims
    vectors: np.ndarray  # sample x dims, unit length
    labels: np.ndarray  # sample
    prior: float
    k: int


def trigram_counts(data: np.ndarray, ends: np.ndarray, features: int) -> np.ndarray:
    """Rows of log(1 + count) of hashed byte trigrams for the texts that end at ``ends``."""
    starts = np.concatenate(([0], ends[:-1]))
    n = len(ends)
    if len(data) < 3:
        return np.zeros((n, features), np.float32)
    b = data.astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = ((code * MIX) >> np.uint32(8)) % np.uint32(features)
    doc = np.repeat(np.arange(n), ends - starts)
    inside = doc[:-2] == doc[2:]
    flat = doc[:-2][inside] * features + slot[inside]
    counts = np.bincount(flat, minlength=n * features).reshape(n, features)
    return np.log1p(counts).astype(np.float32)


#: Steps of each shape term; a document has the terms of all steps that its value reaches.
STEPS = np.array([0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.6, 0.8])
SHAPES = 4 * len(STEPS)
#: Length of the part of a vector that shape terms make, against 1 for the trigrams.
SHAPE_WEIGHT = 0.7
_SIGN, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = True
_DIGIT[48:58] = True


def shape_terms(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: the steps reached by each text's shares."""
    begins = np.concatenate(([0], ends[:-1]))
    size = np.maximum(ends - begins, 1)

    def share(flags, of):
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[of[1:]] - sums[of[:-1]]) / np.maximum(of[1:] - of[:-1], 1)

    bounds = np.concatenate(([0], ends))
    starts, stops, first = words_of(data, ends)
    words = Rolling(data, BASES[0]).ranges(starts, stops)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    packed = [len(zlib.compress(data[a:b].tobytes(), 1)) for a, b in zip(begins, ends, strict=True)]
    values = (np.array(packed) / size, share(_SIGN[data], bounds), share(_DIGIT[data], bounds), share(again, first))
    return np.hstack([v[:, None] >= STEPS for v in values]).astype(np.float32)


def terms(data: np.ndarray, ends: np.ndarray, features: int) -> np.ndarray:
    """Trigram counts and shape terms side by side."""
    return np.hstack([trigram_counts(data, ends, features), shape_terms(data, ends)])


def weighted_terms(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors; rows without trigrams stay zero."""
    grams = _unit(rows[:, :-SHAPES] * idf)
    shapes = _unit(rows[:, -SHAPES:]) * (np.abs(grams).sum(axis=1, keepdims=True) > 0)
    return _unit(np.hstack([grams, SHAPE_WEIGHT * shapes]))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    sample: int = 4096,
    features: int = 2048,
    dims: int = 48,
    k: int = 15,
) -> Model:
    """Learn from at most ``sample`` labelled documents.

    Only the numbered rows of the sample are joined to their texts (a broadcast of
    ``sample`` rows at most); tasks turn texts to counts, so the driver sees
    sample x features small numbers and no text.
    """
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(F.col(label).cast("double")).alias("_label"))
    )
    chosen = smallest_hashes(chosen, "_key", sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    def count(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, "_text"):
                rows = terms(data, ends, features).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), part.column("_label"), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["_key", "_label", "counts"],
                )

    key_type = docs.schema[key].dataType
    schema = T.StructType().add("_key", key_type).add("_label", "double").add("counts", "binary")
    got = rows.mapInArrow(count, schema).toArrow().sort_by("_key")
    if got.num_rows == 0:
        return Model(np.zeros(features, np.float32), np.zeros((features + SHAPES, dims), np.float32), np.zeros((0, dims), np.float32), np.zeros(0), 0.5, k)
    counts = np.vstack([np.frombuffer(b, np.float16) for b in got["counts"].to_pylist()]).astype(np.float32)
    target = np.asarray(got["_label"].to_numpy(), np.float32)
    idf = np.log((1 + len(counts)) / (1 + (counts[:, :-SHAPES] > 0).sum(axis=0))).astype(np.float32) + 1
    weighted = weighted_terms(counts, idf)
    axes = _leading_axes(weighted, min(dims, *weighted.shape))
    return Model(idf, axes, _unit(weighted.astype(np.float64) @ axes), target, float(target.mean()), k)


def _leading_axes(rows: np.ndarray, dims: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors by subspace iteration from a fixed start."""
    rng = np.random.default_rng(0)
    basis = rng.standard_normal((rows.shape[1], min(rows.shape[1], dims + 16))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, vt = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ vt.T)[:, :dims], dtype=np.float32)


def votes(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of rows of counts: the similarity-weighted mean label of the nearest k."""
    vectors = _unit(weighted_terms(counts, model.idf).astype(np.float64) @ model.axes.astype(np.float64))
    scores = np.full(len(counts), model.prior)
    filled = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
    k = min(model.k, len(model.labels))
    if k == 0:
        return scores
    for block in np.array_split(filled, max(1, len(filled) // 512)):
        if len(block) == 0:
            continue
        near = vectors[block] @ model.vectors.T
        # Unique integers: of equal similarities the earlier row is the larger one.
        rank = np.rint(near * 2.0**24).astype(np.int64) * len(model.labels) - np.arange(len(model.labels))
        top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.round(np.take_along_axis(near, top, axis=1), 6), 1e-6) ** 4
        scores[block] = (weight * model.labels[top]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(scores, 0.0, 1.0)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    features = len(model.idf)
    schema = T.StructType([f for f in docs.schema.fields if f.name != name]).add(name, "double")
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            for part, data, ends in blocks_of(batch, text):
                values = votes(shared.value, terms(data, ends, features))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(values)], [*kept, name])

    return docs.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """The fold that no fit may see; NULL keys are outside it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
