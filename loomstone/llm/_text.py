"""Vectorised text primitives over Arrow string buffers: words, word hashes, shingles. Pure numpy, whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Longest range, in bytes, that is hashed along with the others; a longer one goes through a digest of its own.
_LANES = 4


def word_bytes(kind: str) -> np.ndarray:
    """256 flags: which UTF-8 bytes belong to words. 'alnum': ASCII letters, digits and all that is not ASCII; 'nonspace': all but white space."""
    t = np.zeros(256, bool)
    if kind == "alnum":
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    elif kind == "nonspace":
        t[:] = True
        t[0x09:0x0E] = t[0x20] = False
    else:
        raise ValueError(kind)
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes and `rows` rows each, or of one row where that alone is larger."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, doc_first): byte ranges of all words in order, and per document the index of its first word (one entry more)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, by its bytes and length alone; ASCII letters are lower-cased first if lower.

    Eight bytes at a time, each mixed in before the next, so that no algebra of texts makes two ranges collide; ranges above
    8 * _LANES bytes are hashed by a public digest. Temporary memory is about the size of the data and of the ranges."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    lane = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
    out = mix((lane[starts] & keep[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(_BASE)))
    more = np.flatnonzero((size > 8) & (size <= 8 * _LANES))
    for j in range(1, _LANES):
        if not len(more):
            break
        out[more] = mix(out[more] * U64(_BASE) + (lane[starts[more] + 8 * j] & keep[np.minimum(size[more] - 8 * j, 8)]))
        more = more[size[more] > 8 * (j + 1)]
    if len(far := np.flatnonzero(size > 8 * _LANES)):
        import xxhash

        out[far] = [xxhash.xxh3_64_intdigest(padded[a:z]) for a, z in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, doc_first) of all runs of k words of each document; of fewer words, but not none, the whole sequence is one."""
    n, docs = len(hashes), len(first) - 1
    count = np.diff(first)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    out_first = np.zeros(docs + 1, np.int64)
    np.cumsum(many, out=out_first[1:])
    out = np.empty(out_first[-1], U64)
    if n >= k:
        acc = mix(hashes[: n - k + 1] + U64(k))
        for j in range(1, k):
            acc = mix(acc * U64(_BASE) + hashes[j : n - k + 1 + j])
    else:
        acc = np.zeros(0, U64)
    full = count >= k
    if full.any():
        # Positions of each full document's runs: its first word's index and the following.
        at = np.repeat(first[:-1][full] - out_first[:-1][full], many[full])
        where = np.arange(out_first[-1])[np.repeat(full, many)]
        out[where] = acc[at + where]
    for d in np.flatnonzero((count > 0) & ~full):
        x = hashes[first[d] : first[d + 1]]
        h = mix(x[:1] + U64(len(x)))
        for j in range(1, len(x)):
            h = mix(h * U64(_BASE) + x[j : j + 1])
        out[out_first[d]] = h[0]
    return out, out_first


def release() -> None:
    """Give memory that was freed back to the system: an idle worker keeps it else, beside those of the tasks that follow."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """run over a partition's batches, and release() when they are done."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
