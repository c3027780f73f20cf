"""Whole texts of Arrow batches as flat byte arrays, in blocks of bounded size."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20


def blocks_of(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, ends): consecutive rows of about ``limit`` bytes of text, or one longer text.

    ``ends`` are the places in ``bytes`` where each row's text ends; NULL counts as empty.
    """
    column = batch.column(text)
    if batch.num_rows == 0:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row]
        row = stop


#: Two odd multipliers for polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOW[data]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, np.uint64(base))
            up[0] = 1
            down = np.full(size, np.uint64(pow(base, -1, 1 << 64)))
            down[0] = 1
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Cheap polynomial hashes of any ranges of a sequence of integers, modulo 2**64.

    Sequences that collide can be constructed, so these only group or order; equality is
    never decided by them (``RabinKarp`` and ``digests`` are for that).
    """

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of values[start:stop]; equal ranges have equal hashes wherever they stand."""
        return mixed((self.sums[stops] - self.sums[starts]) * self.down[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all runs of ``length`` values."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first): byte ranges of words, and where each text's words begin.

    A word is a run of bytes other than space and 0x09-0x0D; ``first`` has one entry more
    than there are texts. Texts end words.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64)
    inside = ~_SPACE[data]
    begins = np.concatenate(([0], ends[:-1]))
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    edge[len(data)] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    stops = np.flatnonzero(before & (~after | edge))
    return starts, stops, np.concatenate((np.searchsorted(starts, begins), [len(starts)]))


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its least one, the leftmost of equals.

    Values count by their upper 44 bits; places take the lower bits, in stretches of 2**20.
    """
    n = len(h) - width + 1
    low = np.uint64((1 << 20) - 1)
    stretch = (1 << 20) - width
    if stretch < 1:
        raise ValueError("the window is too wide")
    out = np.empty(max(0, n), np.int64)
    for a in range(0, n, stretch):
        m = min(stretch, n - a)
        x = (h[a : a + m + width - 1] & ~low) | np.arange(m + width - 1, dtype=np.uint64)
        span = 1
        while span < width:  # windows of growing length from two overlapping halves
            step = min(span, width - span)
            x = np.minimum(x[: len(x) - step], x[step:])
            span += step
        out[a : a + m] = a + (x & low).astype(np.int64)
    return out


def digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """128-bit XXH3 of byte ranges, as two integers a row."""
    import xxhash

    raw, h = data.tobytes(), xxhash.xxh3_128_digest
    every = b"".join([h(raw[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    return np.frombuffer(every, "<u8").reshape(-1, 2)


PRIME = (1 << 61) - 1
_P, _SIXTY_ONE = np.uint64(PRIME), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & _P) + (x >> _SIXTY_ONE)
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 of reduced values, from halves of 31 bits."""
    low, shift = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> shift, a & low, b >> shift, b & low
    middle = a1 * b0 + a0 * b1
    high = np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << shift)
    return _reduced(_reduced(high) + a0 * b0)


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums modulo 2**61 - 1, by groups of four that cannot overflow."""
    if len(x) <= 4:
        return _reduced(np.cumsum(x, dtype=np.uint64))
    groups = np.zeros((-(-len(x) // 4), 4), np.uint64)
    groups.ravel()[: len(x)] = x
    groups = np.cumsum(groups, axis=1, dtype=np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), _sums(_reduced(groups[:, 3]))[:-1]))
    return _reduced(_reduced(groups) + before[:, None]).ravel()[: len(x)]


@functools.lru_cache(maxsize=8)
def _prime_powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate((out, _product(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))))
    return out[:size]


class RabinKarp:
    """Rabin-Karp hashes modulo the prime 2**61 - 1 of any ranges of a sequence of integers."""

    def __init__(self, values: np.ndarray, base: int):
        size = 1 << max(16, len(values).bit_length())
        self.down = _prime_powers(pow(base, -1, PRIME), size)
        terms = _product(_reduced(values.astype(np.uint64)), _prime_powers(base, size)[: len(values)])
        self.sums = np.concatenate((np.zeros(1, np.uint64), _sums(terms)))

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of values[start:stop]; equal ranges have equal hashes wherever they stand."""
        return _product(_reduced(self.sums[stops] + (_P - self.sums[starts])), self.down[starts])


def spaced(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with one space between the words of a text, and where the words are then."""
    keep = ~_SPACE[data]
    after = stops[stops < len(data)]
    after = after[_SPACE[data[after]]]
    out = data.copy()
    out[after] = 0x20
    keep[after] = True
    place = np.cumsum(keep)
    return out[keep], place[starts] - 1, place[stops - 1]


def distinct_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(codes, words): the distinct words, and for every word its place among them."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    bounds = np.concatenate(([0], np.cumsum(stops - starts)))
    letters = data[~_SPACE[data]]  # all bytes of words, and no others
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
