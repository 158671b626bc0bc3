"""Words of whole texts as numpy arrays: positions and 64-bit hashes, for a slice of documents at a time.

A word is a maximal run of bytes other than space and \\x09-\\x0D (``[^\\x20\\x09-\\x0D]+``),
taken from the UTF-8 form of the text, so positions are byte positions. All functions are
plain numpy over one bounded slice (``slices``); nothing here keeps state between slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20          # texts are worked on in slices of about this many bytes
BASE = 0x9E3779B97F4A7C15      # odd multiplier of the polynomial word hash
SHINGLE_WORDS = 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3 constants) over a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) row ranges holding about ``limit`` bytes each (one longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_table(raw: np.ndarray, offsets: np.ndarray, pow_cache: dict | None = None):
    """(starts, ends, doc, hash) of every word of the rows whose byte offsets are given.

    starts/ends are absolute byte positions in ``raw``; doc is the row number in the slice;
    hash depends on the word's bytes alone.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = raw[lo:hi]
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets - lo] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cache = pow_cache if pow_cache is not None else {}
    if cache.get("n", 0) < n:
        cache["up"], cache["down"] = powers(max(n, SLICE_BYTES + 65536))
        cache["n"] = len(cache["up"])
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * cache["up"][:n], out=total[1:])
    h = mix64((total[ends] - total[starts]) * cache["down"][starts] + (ends - starts).astype(np.uint64))
    doc = np.searchsorted(offsets - lo, starts, side="right") - 1
    return starts + lo, ends + lo, doc, h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (positions 0 .. len-k), across documents too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[:len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(BASE) + h[i:len(h) - k + 1 + i]
    return mix64(out)


def shingles(h: np.ndarray, counts: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets by row): every k consecutive words of a row.

    A row of 1 to k-1 words has one shingle, all its words; a row without words has none.
    """
    counts = np.asarray(counts, np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    off = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(off[-1], np.uint64)
    full = counts >= k
    g = grams(h, k)
    if full.any():
        rows = np.flatnonzero(full)
        reps = each[rows]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out[np.repeat(off[rows], reps) + inner] = g[np.repeat(begin[rows], reps) + inner]
    for r in np.flatnonzero(~full & (counts > 0)):
        x = h[begin[r]:begin[r + 1]]
        v = x[:1].copy()
        for w in x[1:]:
            v = v * np.uint64(BASE) + w
        out[off[r]] = mix64(v)[0] ^ np.uint64(len(x))
    return out, off
