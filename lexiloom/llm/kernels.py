"""Vectorised text kernels over Arrow buffers, shared by the operators of this subpackage.

All of them take the UTF-8 bytes of many documents at once, so that the cost of a
document is some nanoseconds a byte and no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
#: Bytes handled at a time: the work arrays are a few dozen times as large.
SLICE_BYTES = (1 << 20) - 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Odd bases, 3 modulo 8, of the rolling hashes modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93
#: Words of the widest window that is one Rabin-Karp hash.
BASE_WORDS = 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def trim() -> None:
    """Give freed memory back: a Python worker that waits for its next task should be small."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def calm(run: Callable) -> Callable:
    """The map over batches, with its memory given back at the end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting them: many times faster than numpy's own way for numbers that mostly differ."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (out[0], out[1])
        if size > 1 << 24:  # not kept beyond one huge text
            _POWERS.pop(base)
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of the short runs values[start:end], equal for equal runs wherever they lie.

    Runs of two alternating values lose bits with their length (13 of 64 for 16 values, all for 1,024): see run_hashes for long ones.
    """
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


#: Masks of the first 0 to 8 bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_PLACE_STEP, _SIZE_STEP = U64(0x9E6C63D0876A9A47), U64(0xD1B54A32D192ED03)


def loads(b: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number at every place of a byte run, zeros beyond its end."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray(len(b), "<u8", padded, 0, (1,))


def run_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs b[start:end], equal for equal runs. Every 8 bytes are mixed with their place in the run before they
    are summed, so that no pattern of bytes, however long or regular, cancels out (as it can in a polynomial modulo 2^64)."""
    at = loads(b)
    size = (ends - starts).astype(np.int64)
    n = np.maximum(-(-size // 8), 1)
    x = at[starts] if len(at) else np.zeros(len(starts), U64)
    total = mix((x & _FIRST[np.minimum(size, 8)]) + _PLACE_STEP)
    long = np.flatnonzero(n > 1)
    if len(long):
        more = n[long] - 1
        first = np.cumsum(more) - more
        k = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        place = np.repeat(starts[long], more) + 8 * k
        left = np.repeat(ends[long], more) - place
        piece = mix((at[place] & _FIRST[np.minimum(left, 8)]) + _PLACE_STEP * (k + 1).astype(U64))
        total[long] += np.add.reduceat(piece, first)
    return mix(total ^ (size.astype(U64) * _SIZE_STEP))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `limit` bytes; a longer document is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _pieces(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets with longer documents cut at white space, for word hashing in bounded memory."""
    cuts, long = [], np.flatnonzero(np.diff(off) > 2 * SLICE_BYTES)
    for d in long:
        at, end = int(off[d]), int(off[d + 1])
        while end - at > 2 * SLICE_BYTES:
            look = at + SLICE_BYTES
            while look < end:
                stop = min(look + 4096, end)
                hit = np.flatnonzero(_SPACE[raw[look:stop]])
                if len(hit):
                    break
                look = stop
            else:
                break
            at = look + int(hit[0])
            cuts.append(at)
    return np.unique(np.concatenate([off, np.asarray(cuts, np.int64)])) if cuts else off


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each document where its words begin."""
    b0 = int(off[0])
    b = raw[b0 : int(off[-1])]
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edge = off[1:-1] - b0
    edge = edge[(edge > 0) & (edge < len(b))]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    both = edge[inside[edge] & inside[edge + 1]]
    first[both] = True
    last[both] = True
    starts, ends = np.flatnonzero(first) + b0, np.flatnonzero(last) + b0
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and the word offsets of the documents; a word's hash depends on its bytes alone."""
    cut = _pieces(raw, off)
    parts = []
    for i, j in slices(cut):
        s, e, _ = words(raw, cut[i : j + 1])
        b = raw[cut[i] : cut[j]]
        if lower:
            b = _LOWER[b]
        parts.append((run_hashes(b, s - cut[i], e - cut[i]), s, e))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, np.zeros(len(off), np.int64)
    h, s, e = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return h, s, e, np.searchsorted(s, off)


def byte_values(b: np.ndarray) -> np.ndarray:
    return _BYTE[b]


def lower_bytes(b: np.ndarray) -> np.ndarray:
    return _LOWER[b]


def window_hashes(h: np.ndarray, word_off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in words) and hashes of every window of `width` words inside one document.

    Windows of up to BASE_WORDS words have the Rabin-Karp hash of the (mixed) word hashes; of wider ones, the hashes of their first and
    last halves are mixed, again and again, so that sums modulo 2^64 run over BASE_WORDS terms at most.
    """
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    ok = np.ones(len(h) + 1, np.int8)
    ok[len(h) - width + 1 :] = 0
    for e in range(1, width):  # starts whose window would cross the end of a document
        at = word_off[1:] - e
        ok[at[at >= 0]] = 0
    starts = np.flatnonzero(ok)
    size = min(width, BASE_WORDS)
    every = np.arange(len(h) - size + 1)
    found = rolling(h, WORD_BASE, every, every + size)
    while size < width:
        step = min(size, width - size)
        found = mix(found[: len(found) - step] * U64(WORD_BASE) + found[step:])
        size += step
    return starts, found[starts]


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the windows."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + width, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    d = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as byte planes of their differences: the high planes compress to nothing."""
    return np.diff(sorted_hashes, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).reshape(-1), dtype=U64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` values, by van Herk's two scans over blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = -(-len(x) // width) * width
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def cover_ranges(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
