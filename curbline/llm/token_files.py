"""Token-id files: one zstandard frame per document, a shared dictionary, an offset index.

The dictionary is trained once on the serialized ids of a bounded sample of documents
(``sample`` rows with the smallest hash of the key among texts of up to ``longest``
characters; it only affects how well files compress). Documents are laid out in ascending
key order by a range partitioning; every task streams its documents into one file and
returns one manifest row, so files of lost or repeated attempts are never read.

Layout of a file: magic, SHA-256 of the dictionary, the frames, then the index as an Arrow
stream (key, offset, size, n_tokens) and its length. ``read_document`` reads the
index and one frame; ``read`` streams whole files in tasks.

Defined results: strings of special tokens in a text (such as ``<|endoftext|>``) get these
tokens' ids, as by the library's plain ``encode``; NULL and empty texts hold only the end id; NULL keys come first; rows with
equal keys keep any order among themselves and are all kept; an empty table gives no files
and no rows; other columns are not stored.
"""

from __future__ import annotations

import functools
import hashlib
import io
import json
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import blocks_of, distinct_words, folded, words_of
from .common import attempt_name, opened, shared_folder, smallest_hashes

MAGIC = b"TOKZ0001"
#: Pieces of each of the two generations that a worker remembers; a cache, not a limit on input.
MEMO_PIECES = 300_000
#: Text that is split to words at once.
TEXT_BYTES = 8 << 20
#: The normalisation and splitting for which words are independent of each other.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
#: Bytes that only the library judges: the apostrophe, controls, and signs beyond ASCII but letters below U+0240.
ODD = np.zeros(256, bool)
ODD[[39, *range(32), 127, 0xC2, *range(0xC9, 256)]] = True
#: Pairs of bytes within that range that are no letters, or change their length in lower case.
ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: 0 letters, 1 signs, 2 digits.
KIND = np.ones(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
KIND[48:58] = 2
SPECIAL = b"<|"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(moved)) for b in range(256)}


def split_words(data: np.ndarray, ends: np.ndarray):
    """(bytes, starts, stops, first, odd): pieces of words in lower case; odd words stay whole.

    Blocks that may hold special tokens, whose case matters, keep theirs.
    """
    special = SPECIAL in data.tobytes()
    odd_byte = ODD[data]
    for one, two in ODD_PAIRS:
        odd_byte[:-1] |= (data[:-1] == one) & (data[1:] == two)
    if special:
        odd_byte |= data == SPECIAL[0]
    starts, stops, first = words_of(data, ends)
    before = np.concatenate(([0], np.cumsum(odd_byte, dtype=np.int32)))
    odd = before[stops] > before[starts]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[~odd]] += 1
    step[stops[~odd]] -= 1
    kind = KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut &= np.cumsum(step[:-1], dtype=np.int8) > 0
    cut[starts] = True
    begin = np.flatnonzero(cut)
    word = np.searchsorted(starts, begin, side="right") - 1
    stop = np.minimum(np.concatenate((begin[1:], [len(data)])), stops[word])
    bounds = np.concatenate((np.searchsorted(begin, np.concatenate(([0], ends[:-1]))), [len(begin)]))
    return data if special else folded(data), begin, stop, bounds, odd[word]


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, every distinct word of a block once.

    White space is dropped and neither a token nor a normalisation spans it, so the ids of a text are the
    ids of its words one after the other. Words of ASCII signs, digits and letters below U+0240 fall
    to runs of letters, runs of signs and single digits, which go to the library's merge model
    directly; other words go through the whole library. That holds for files with the splitting stated
    above, which is checked; with any other file whole texts go through the library. Strings of
    special tokens get the ids of these tokens, as in the library's plain ``encode``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("token files are written on little-endian machines")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_word = self._splits_words(json.loads(self.library.to_str()))

    @staticmethod
    def _splits_words(config: dict) -> bool:
        normal = (config.get("normalizer") or {}).get("normalizers", [])
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [x["type"] for x in normal] == NORMAL
            and normal[1]["pattern"] == {"Regex": "\\s+"}
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": SPLIT}
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and (steps[1]["add_prefix_space"], steps[1]["use_regex"]) == (False, False)
        )

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece by the merge model."""
        have = self.memo.get(piece)
        if have is None:
            have = self.old.get(piece)
            if have is None:
                bytes_ = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                have = array(self.code, [t.id for t in self.model.tokenize(bytes_)]).tobytes()
            self.memo[piece] = have
        return have

    def pieces(self, found: list[bytes], odd: np.ndarray) -> list[bytes]:
        """Serialized ids of each piece; odd ones are whole words for the library."""
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.old = {}, self.memo
        out = [b"" if o else self._piece(p.decode().lower()) for p, o in zip(found, odd.tolist(), strict=True)]
        rest = np.flatnonzero(odd).tolist()
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for k, got in zip(part, self.library.encode_batch_fast([found[k].decode() for k in part], add_special_tokens=False), strict=True):
                out[k] = array(self.code, got.ids).tobytes()
        return out

    def block(self, data: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of all texts, each closed by ``end_id``, and where texts begin and end."""
        if not self.by_word:
            whole, begins = data.tobytes(), [0, *ends[:-1].tolist()]
            texts = [whole[a:b].decode() for a, b in zip(begins, ends.tolist(), strict=True)]
            got = [[*e.ids, end_id] for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], self.width), np.cumsum([0, *map(len, got)])
        data, starts, stops, first, odd = split_words(data, ends)
        codes, known = distinct_words(data, starts, stops)
        alone = np.zeros(len(known), bool)
        alone[codes[odd]] = True
        ids = [*self.pieces(known, alone), np.array([end_id], self.width).tobytes()]
        flat = np.frombuffer(b"".join(ids), self.width)
        sizes = np.array([len(x) // self.width.itemsize for x in ids])
        at = np.cumsum(sizes) - sizes
        codes = np.insert(codes, first[1:], len(known))
        counts = sizes[codes]
        stop = np.cumsum(counts)
        place = np.arange(int(counts.sum())) + np.repeat(at[codes] - (stop - counts), counts)
        closed = first[1:] + np.arange(len(ends))
        return flat[place], np.concatenate(([0], stop[closed]))

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Serialized ids of each text, ``end_id`` last."""
        raw = [(t or "").encode() for t in texts]
        ids, bounds = self.block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]), end_id)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer, which remembers what it has encoded."""
    return WordTokenizer(path)


def train(docs: DataFrame, path: str, key: str, text: str, end_id: int, sample: int, longest: int, size: int) -> bytes:
    """A raw zstandard dictionary; empty if there is too little text to learn from."""
    import zstandard

    short = docs.where((F.length(text) <= longest) & F.col(key).isNotNull())
    chosen = smallest_hashes(short.select(F.col(key).alias("k")), "k", sample)
    rows = short.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").orderBy("k", "t").select("t")
    own = tokenizer(path)
    texts = [r["t"] for r in rows.collect()]
    samples = own.encode(texts, end_id) if texts else []
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    sample: int = 1000,
    longest: int = 8192,
    dictionary_size: int = 65536,
    level: int = 1,
) -> DataFrame:
    """Encode and write; returns the manifest, one row per file in key order.

    Manifest: file, n_docs, n_tokens, start (ids in all files before it).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, path, key, text, end_id, sample, longest, dictionary_size))
    placed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(width, "key").sortWithinPartitions("key")
    key_type = pa.int64() if isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType)) else pa.string()

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        own = tokenizer(path)
        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=words).compress
        part = TaskContext.get().partitionId()
        out, name, index, total = None, attempt_name(f"{folder}/part-{part:06d}", ".tokz"), [], 0
        for batch in batches:
            for rows, data, ends in blocks_of(batch, "text", TEXT_BYTES):
                ids, bounds = own.block(data, ends, end_id)
                if out is None:
                    fs, where = opened(name)
                    out = fs.open_output_stream(where)
                    out.write(MAGIC + hashlib.sha256(shared.value).digest() + bytes([own.width.itemsize]))
                    place = len(MAGIC) + 33
                raw = memoryview(ids).cast("B")
                bytes_ = (bounds * own.width.itemsize).tolist()
                frames = [pack(raw[a:b]) for a, b in zip(bytes_[:-1], bytes_[1:], strict=True)]
                sizes = np.array(list(map(len, frames)), np.int64)
                counts = np.diff(bounds)
                index.append(
                    pa.RecordBatch.from_arrays(
                        [rows.column("key").cast(key_type), pa.array(place + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts)],
                        ["key", "offset", "size", "n_tokens"],
                    )
                )
                place, total = place + int(sizes.sum()), total + int(counts.sum())
                out.write(b"".join(frames))
        if out is None:
            return
        listed = pa.Table.from_batches(index)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, listed.schema) as stream:
            stream.write_table(listed)
        out.write(sink.getvalue() + len(sink.getvalue()).to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [listed.num_rows], "n_tokens": [total]})

    rows = placed.mapInArrow(run, "part long, file string, n_docs long, n_tokens long")
    got = rows.toArrow().sort_by("part").to_pylist()  # one row per file
    fs, where = opened(f"{folder}/dictionary")
    with fs.open_output_stream(where) as out:
        out.write(shared.value)
    manifest, start = [], 0
    for r in got:
        manifest.append((r["file"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(manifest, "file string, n_docs long, n_tokens long, start long")


def _dictionary(folder: str) -> bytes:
    fs, where = opened(f"{folder}/dictionary")
    with fs.open_input_stream(where) as file:
        return file.read()


def _open(name: str):
    """(file, id width, index) of one token file whose dictionary hash has been checked."""
    import zstandard

    fs, where = opened(name)
    file = fs.open_input_file(where)
    head = file.read_at(len(MAGIC) + 33, 0)
    tail = file.read_at(16, file.size() - 16)
    if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC:
        raise ValueError(f"not a token file: {name}")
    shared = _dictionary(name.rsplit("/", 1)[0])
    if hashlib.sha256(shared).digest() != head[len(MAGIC) : len(MAGIC) + 32]:
        raise ValueError(f"another dictionary than the file's: {name}")
    size = int.from_bytes(tail[:8], "little")
    index = pa.ipc.open_stream(file.read_at(size, file.size() - 16 - size)).read_all()
    words = zstandard.ZstdCompressionDict(shared) if shared else None
    return file, np.dtype(f"<u{head[-1]}"), index, zstandard.ZstdDecompressor(dict_data=words)


def read_document(name: str, key) -> np.ndarray | None:
    """The ids of one document; reads the index and one frame."""
    file, width, index, unpack = _open(name)
    with file:
        import pyarrow.compute as pc

        row = index.filter(pc.equal(index["key"], key)).slice(0, 1).to_pylist()
        if not row:
            return None
        frame = file.read_at(row[0]["size"], row[0]["offset"])
        return np.frombuffer(unpack.decompress(frame), width)


def _documents(name: str, chunk: int = 512):
    """(index rows, list of id arrays) of consecutive documents."""
    file, width, index, unpack = _open(name)
    with file:
        for at in range(0, index.num_rows, chunk):
            part = index.slice(at, chunk)
            first, sizes = part["offset"][0].as_py(), part["size"].to_pylist()
            raw = file.read_at(sum(sizes), first)
            ends = np.cumsum(sizes)
            yield part, [np.frombuffer(unpack.decompress(raw[e - s : e]), width) for s, e in zip(sizes, ends.tolist(), strict=True)]


def _over_files(manifest: DataFrame, make, schema) -> DataFrame:
    files = manifest.select("file", "start")
    count = max(1, files.count())
    return files.repartition(min(count, 4096), "file").mapInArrow(make, schema)


def read(manifest: DataFrame, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, start, ids) of every document in the files."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for part, ids in _documents(name):
                    counts = part["n_tokens"].to_numpy()
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                    flat = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part["key"].combine_chunks(), pa.array(starts), flat], [key, "start", "ids"])

    return _over_files(manifest, run, f"{key} {key_type}, start long, ids array<int>")


def checksums(manifest: DataFrame, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the ids in the files."""

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for part, ids in _documents(name):
                    counts = np.array([len(x) for x in ids], np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part["key"].combine_chunks(), pa.array(starts), pa.array(counts), crc], [key, "start", "n_tokens", "ids_crc32"]
                    )

    return _over_files(manifest, run, f"{key} {key_type}, start long, n_tokens long, ids_crc32 long")


def written(docs: DataFrame, path: str, **options) -> DataFrame:
    """``write`` into a fresh folder below the shared one."""
    return write(docs, shared_folder(docs.sparkSession, "token-files"), path, **options)
