"""Words of UTF-8 texts as numpy arrays, an Arrow batch at a time.

The operators on words run in ``mapInArrow``: Spark deals the rows, and inside a task a block of
whole texts is cut into words and hashed with a few vector operations, without a Python object per
word. A block holds whole texts and, unless one text alone is longer, at most ``BLOCK`` bytes, so
memory depends on the longest text and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once.
BLOCK = 2 << 20
# Bytes hashed at once; a longer text is cut between words.
SEGMENT = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _table(keep, lower: bool = False) -> np.ndarray:
    """256 bytes: what each byte becomes; 0 separates words."""
    out = np.zeros(256, np.uint8)
    for byte in range(256):
        if keep(byte):
            out[byte] = byte + 32 if lower and 65 <= byte <= 90 else byte
    return out


# The two kinds of words. Bytes from 0x80 on belong to code points beyond ASCII.
SPACES = {0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D}
#: Runs of anything but ASCII white space, unchanged.
RAW = "raw"
#: The same with A-Z lower-cased.
LOWER = "lower"
#: Lower-cased runs of a-z, 0-9 and everything beyond ASCII.
PLAIN = "plain"
TABLES = {RAW: _table(lambda b: b not in SPACES),
          LOWER: _table(lambda b: b not in SPACES, lower=True),
          PLAIN: _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80, lower=True)}
_INSIDE = {kind: table > 0 for kind, table in TABLES.items()}
_INSIDE[RAW][0] = _INSIDE[LOWER][0] = True  # byte 0 separates no words there


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= SEGMENT + 1:
            _POWERS[kind] = have
    return have


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices whose texts hold at most ``limit`` bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and the offsets of the rows in it. NULL is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a block of texts: ``start`` and ``end`` bytes, a 64-bit ``hash`` each, and row borders.

    Row r has words ``first[r]`` to ``first[r + 1]``. For each length in ``stems`` there is a hash of the
    first so many bytes of each word in ``stem``; 0 for words that are no longer than that.
    """

    def __init__(self, column: pa.Array, kind: str, hashed: bool = True, stems: tuple[int, ...] = ()):
        self.raw, self.offsets = text_bytes(column)
        inside = _INSIDE[kind][self.raw]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.stem = {n: np.zeros(len(self.start), np.uint64) for n in stems}
        self.hash = self._hash(TABLES[kind]) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def _hash(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SEGMENT, "right")))
            high = self.end[to - 1]
            n = int(high - low)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[table[self.raw[low:high]]] * _powers("up", _BASE, n)[:n], out=sums[1:])
            s = self.start[at:to] - low
            down = _powers("down", _INVERSE, n + 1)[s]
            out[at:to] = (sums[self.end[at:to] - low] - sums[s]) * down
            for size, stem in self.stem.items():
                cut = np.minimum(s + size, self.end[at:to] - low)
                longer = s + size < self.end[at:to] - low
                stem[at:to] = np.where(longer, mix((sums[cut] - sums[s]) * down + np.uint64(size)), 0)
            at = to
        return mix(out)

    def bytes(self, k: int) -> bytes:
        return self.raw[self.start[k]:self.end[k]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, at the place of the first; shorter by n - 1."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= _BASE
        out += hashes[k:k + size]
    return mix(out + np.uint64(n))


def at_grams(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """``grams`` of n words at some places only."""
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        out *= _BASE
        out += hashes[start + k]
    return mix(out + np.uint64(n))


def whole(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Of ``size`` places: does a run of n words that starts here stay within its row?"""
    ok = np.ones(size, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < size)]] = False
    return ok


def windowed_min(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the rightmost smallest value among ``width`` consecutive ones, for each start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values.copy(), np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        size = len(best) - step
        right = best[step:] <= best[:size]
        at = np.where(right, at[step:], at[:size])
        best = np.where(right, best[step:], best[:size])
        span += step
    return at[:n]
