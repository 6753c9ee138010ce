"""Array kernels over the UTF-8 bytes of whole texts. All work on a few MB at a time."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 19

#: The bytes that separate words.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False


def trim() -> None:
    """Give free memory back to the machine, which a worker between two stages else keeps."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(run):
    """A function of batches or of a group that gives free memory back at its end."""
    if inspect.isgeneratorfunction(run):

        @wraps(run)
        def mapper(batches):
            yield from run(batches)
            trim()

        return mapper

    @wraps(run)
    def grouped(group):
        out = run(group)
        trim()
        return out

    return grouped


def split_by_bytes(batch: pa.RecordBatch, column: int, limit: int = CHUNK, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text (a longer text comes alone) and at most
    ``rows`` rows each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, base + limit, "right"))), at + rows)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes one after another, and where each begins (one more entry than texts)."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


#: The modulus of the polynomial hashes, a Mersenne prime. Modulo a power of two, whatever the base,
#: there are unequal texts of 2,048 characters with equal hashes (the Thue-Morse word is one).
PRIME = U64((1 << 61) - 1)
#: The points at which the polynomials are evaluated.
BASES = (0x11D3A7C95E8B2F41, 0x0B5F2E6D93A4C187)
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
#: Bytes over which unreduced sums stay below 2**64.
_STRETCH = 1 << 22


def reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo PRIME."""
    x = (x & PRIME) + (x >> U64(61))
    np.subtract(x, PRIME, out=x, where=x >= PRIME)
    return x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below PRIME."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << U64(1)) + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + a0 * b0)


@lru_cache(2)
def byte_codes(fold: bool) -> np.ndarray:
    """The coefficient of each byte, from 1; with ``fold`` A-Z have those of a-z."""
    codes = np.arange(1, 257, dtype=np.uint64)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int, base: int) -> list[np.ndarray]:
    """base**i (its lower 31 bits and its upper ones) and base**-i modulo PRIME for i below n at least.
    Those for a chunk stay for the next one."""
    if base in _powers and len(_powers[base][0]) >= n:
        return _powers[base]
    size = max(n, CHUNK + 4096)
    both = []
    for x in (base, pow(base, -1, int(PRIME))):
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = product(out[:step], np.full(1, pow(x, done, int(PRIME)), np.uint64))
            done += step
        both.append(out)
    made = [both[0] & _LOW31, both[0] >> U64(31), both[1]]
    if size <= CHUNK + 4096:
        _powers[base] = made
    return made


class RangeHash:
    """Hashes of any byte ranges of ``raw``: polynomials modulo a prime of 61 bits. Two unequal ranges
    of n bytes are equal for at most n of the 2**61 bases. ``which`` picks one of two independent bases."""

    def __init__(self, raw: np.ndarray, fold: bool = False, which: int = 0):
        low, high, self.down = powers(len(raw) + 1, BASES[which])
        codes = byte_codes(fold)[raw]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        for a in range(0, len(raw), _STRETCH):
            b = min(a + _STRETCH, len(raw))
            upper = reduced(np.cumsum(codes[a:b] * high[a:b]))
            # times 2**31 modulo PRIME is a rotation
            upper = ((upper & _LOW30) << U64(31)) + (upper >> U64(30))
            self.sums[a + 1 : b + 1] = reduced(upper + reduced(np.cumsum(codes[a:b] * low[a:b])) + self.sums[a])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(product(reduced(self.sums[end] + (PRIME - self.sums[start])), self.down[start]))


def gram_hashes(raw: np.ndarray, doublings: int) -> np.ndarray:
    """Quick hashes of the 2**doublings (8 at least) bytes from each place, for dealing only: unequal
    texts may have equal ones."""
    h, width = raw.astype(np.uint64), 1
    for _ in range(doublings):
        left, right = h[: max(0, len(h) - width)], h[width:]
        h = (left << U64(8 * width)) | right if width < 8 else mix(left * U64(3) + right)
        width *= 2
    return mix(h)


def word_ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and how many words precede each text (one more entry than texts)."""
    n = len(raw)
    word = IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    before = inner[inner > 0] - 1
    ends[before] = word[before]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def owner(bounds: np.ndarray) -> np.ndarray:
    """For items dealt to texts by ``bounds``: the text of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def range_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each range between neighbouring offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and their bounds by text. A text with
    fewer words, one at least, has its whole sequence as its one run."""
    per = np.diff(bounds)
    n = len(words)
    full = np.maximum(per - width + 1, 0)
    count = np.where((per > 0) & (per < width), 1, full)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(max(n, 1), np.uint64)[:n]
    for k in range(width):
        factor = U64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        rolled[: n - k] += words[k:] * factor if k else words * factor
    starts = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    out = mix(rolled[starts]) if len(starts) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((per > 0) & (per < width)):
        factors = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(per[i])], np.uint64)
        total = (words[bounds[i] : bounds[i + 1]] * factors).sum(keepdims=True) + U64(int(per[i]))
        out[out_bounds[i]] = mix(total)[0]
    return out, out_bounds
