"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the tokenizer's pattern. Pieces that a task has not met yet are encoded
together: pieces of similar length form a padded matrix of ids, and in every round each row
merges its leftmost pair of minimum rank; rows without a mergeable pair leave the matrix
(compaction). Pair ranks come from an open-addressing hash table in numpy. A piece that is
itself a token takes its id, as in the tiktoken library. Encodings of pieces are kept in a
bounded memo per worker; whatever does not fit is encoded again.

Whole texts are encoded row by row without a shuffle, so nothing depends on group sizes.

Defined results: NULL and empty texts give no ids and decode to nothing; ids outside the
vocabulary raise on decoding; repeated rows are each encoded; other columns pass through.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NONE = np.int64(1 << 40)
#: Pieces whose encodings a worker remembers before it starts anew; a cache, not a limit on input.
MEMO_PIECES = 300_000
#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 18


class Vocabulary:
    """Ranks of byte strings and the hashed table of mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._build(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int64))

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Place all keys by linear probing, one probe distance per round."""
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, NONE)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            at = (slot[left] + self.probes) & (size - 1)
            free = self.values[at] == NONE
            _, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[at[free][first]], self.values[at[free][first]] = keys[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE; ids below 0 are padding."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot, out = self._slot(keys), np.full(keys.shape, NONE)
        mask = len(self.keys) - 1
        open_ = (left >= 0) & (right >= 0)
        for probe in range(self.probes):
            at = (slot[open_] + probe) & mask
            hit = self.keys[at] == keys[open_]
            out[open_] = np.where(hit, self.values[at], out[open_])
            still = open_.copy()
            still[open_] = ~hit & (self.values[at] != NONE)
            open_ = still
            if not open_.any():
                break
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int64)
            elif piece:
                rest.append(i)
            else:
                out[i] = np.zeros(0, np.int64)
        rest.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rest):
            stop, shortest = at + 1, len(pieces[rest[at]])
            # One bucket: lengths within a quarter of each other, and a bounded matrix.
            while (
                stop < len(rest)
                and len(pieces[rest[stop]]) <= shortest + max(2, shortest // 4)
                and (stop - at + 1) * len(pieces[rest[stop]]) <= MATRIX_CELLS
            ):
                stop += 1
            for i, ids in zip(rest[at:stop], self._encode_bucket([pieces[i] for i in rest[at:stop]]), strict=True):
                out[i] = ids
            at = stop
        return out

    def _encode_bucket(self, pieces: list[bytes]) -> list[np.ndarray]:
        width = max(map(len, pieces))
        if len(pieces) == 1 and width > 4096:
            return [self._encode_long(pieces[0])]
        length = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), np.int64(-1))
        ids[np.arange(width) < length[:, None]] = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            every = np.arange(len(rows))
            least = ranks[every, best] if ranks.shape[1] else np.full(len(rows), NONE)
            live = least < NONE
            for r in np.flatnonzero(~live):
                done[rows[r]] = ids[r, : length[rows[r]]].copy()
            if not live.all():
                rows, ids, ranks, best, least = rows[live], ids[live], ranks[live], best[live], least[live]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            # Replace the pair by its merge and move what follows one place to the left.
            columns = np.arange(ids.shape[1] - 1)
            moved = np.where(columns >= best[:, None] + 1, ids[:, 1:], ids[:, :-1])
            moved[every, best] = least
            length[rows] -= 1
            ids = moved[:, : length[rows].max()]
            shifted = np.where(columns[:-1] >= best[:, None] + 1, ranks[:, 1:], ranks[:, :-1])[:, : ids.shape[1] - 1]
            for side in (best - 1, best):  # only the two pairs beside the merge change
                ok = (side >= 0) & (side < ids.shape[1] - 1)
                if ok.any():
                    shifted[every[ok], side[ok]] = self.pair_ranks(ids[every[ok], side[ok]], ids[every[ok], side[ok] + 1])
            ranks = shifted
        return done

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """One very long piece: the same merges, all occurrences of a round's pair at once.

        Merging the leftmost pair of least rank again and again is, while that rank stays
        the least, a sweep from left to right over its occurrences that do not overlap.
        """
        ids = self.start[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            least = ranks.min()
            if least == NONE:
                break
            places = np.flatnonzero(ranks == least)
            if len(places) > 1:  # in a run of overlapping places every second one merges
                run = np.concatenate(([0], np.cumsum(np.diff(places) > 1)))
                first = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
                places = places[(np.arange(len(places)) - first[run]) % 2 == 0]
            # A merge can make a pair of a lower rank only with its neighbours; stop there.
            merged = ids.copy()
            merged[places] = least
            kept = np.ones(len(ids), bool)
            kept[places + 1] = False
            after = merged[kept]
            lower = self.pair_ranks(after[:-1], after[1:]) < least if len(after) > 1 else np.zeros(0, bool)
            if lower.any() and len(places) > 1:  # do the leftmost merge alone and look again
                ids = np.concatenate((ids[: places[0]], [least], ids[places[0] + 2 :]))
            else:
                ids = after
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read a rank file once per process."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})


class Encoder:
    """Encodes whole texts; remembers pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        new = list(set().union(*split).difference(self.memo))
        for piece, ids in zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True):
            self.memo[piece] = ids.astype("<u4").tobytes()
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), "<u4") for pieces in split]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _parts(batch: pa.RecordBatch, text: str, limit: int = 1 << 21):
    """Consecutive rows with about ``limit`` characters of text."""
    texts = batch.column(text).to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text, an array of integers."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != name]).add(name, T.ArrayType(T.IntegerType(), False))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for start, texts in _parts(batch, text):
                part = batch.slice(start, len(texts))
                ids = own.encode(texts)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                column = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), column], [*kept, name])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for; NULL ids give NULL."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != name]).add(name, "binary")
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = [None if x is None else own.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, name])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass over the texts.

    The same encoder and decoder as above; the ids stay in the task, so a table of
    digests does not move them between Spark and Python.
    """
    import hashlib

    schema = (
        T.StructType().add(key, docs.schema[key].dataType).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    )
    names = schema.fieldNames()

    def run(batches):
        own = encoder(path, pattern)
        decimal = [b"%d" % i for i in range(max(own.vocabulary.tokens) + 1)]
        for batch in batches:
            for start, texts in _parts(batch, text):
                rows = []
                for ids in own.encode(texts):
                    numbers = ids.tolist()
                    listed = b",".join(map(decimal.__getitem__, numbers))
                    decoded = own.vocabulary.decode(numbers)
                    rows.append((len(numbers), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                counts, listed, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(listed), pa.array(decoded)], names
                )

    return docs.select(key, text).mapInArrow(run, schema)
