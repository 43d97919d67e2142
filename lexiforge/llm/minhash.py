"""Shingle sets and MinHash signatures in numpy, over whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix, ranges, split_words

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct shingles in ascending order, the texts' bounds).

    A-Z count as a-z.  A text of fewer than ``width`` words has its whole sequence as the one
    shingle; one without words has none."""
    n = len(texts)
    words, rows = split_words(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = hashed[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = ranges(first, made)
    owner_count = np.repeat(np.minimum(counts, width), made)
    value = np.full(len(at), np.uint64(width))
    for k in range(width):
        inside = owner_count > k
        step = mix(value[inside] ^ h[at[inside] + k])
        value[inside] = step
    # A short sequence hashes apart from the full shingles by its length.
    value = np.where(owner_count < width, mix(value + owner_count.astype(np.uint64)), value)
    ends = np.cumsum(made)
    for s, e in zip((ends - made).tolist(), ends.tolist(), strict=True):
        value[s:e].sort()
    owner = np.repeat(np.arange(n), made)
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=n))])


def superminhash(values: np.ndarray, bounds: np.ndarray, size: int, max_cells: int = 24 << 20) -> np.ndarray:
    """SuperMinHash signatures: (sets, size) of uint64.

    Element x draws, in step j, a rank r in [j, j + 1) and swaps its own permutation's place j with
    a random later one; the signature keeps the least rank of each place.  The steps run for all
    elements of a set together: ranks of later steps are larger, so a set stops as soon as all
    places are filled, and only sets with places left go on."""
    n = len(bounds) - 1
    sig = np.full((n, size), EMPTY)
    lengths = np.diff(bounds)
    most = max(1, max_cells // size)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        _super_run(values[bounds[start] : bounds[stop]], lengths[start:stop], sig[start:stop])
        start = stop
    return sig


def _super_run(values: np.ndarray, lengths: np.ndarray, sig: np.ndarray) -> None:
    size = sig.shape[1]
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(len(lengths)), lengths)
    perm: np.ndarray | None = None
    first = None
    for j in range(size):
        if not len(values):
            return
        z = mix(values + np.uint64(j + 1) * np.uint64(0x342543DE82EF95))
        k = j + (mix(z) % np.uint64(size - j)).astype(np.int64)
        if j == 0:
            place = first = k
        else:
            if perm is None:
                perm = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(values), 1))
                lanes = np.arange(len(values))
                perm[lanes, 0], perm[lanes, first] = first, 0
            lanes = np.arange(len(values))
            place = perm[lanes, k].astype(np.int64)
            perm[lanes, k] = perm[lanes, j]
            perm[lanes, j] = place
        np.minimum.at(flat, row * size + place, (np.uint64(j) << np.uint64(53)) | (z >> np.uint64(11)))
        open_rows = (sig == EMPTY).any(axis=1)
        keep = open_rows[row]
        if not keep.all():
            values, row = values[keep], row[keep]
            first = first[keep] if perm is None else first
            perm = perm[keep] if perm is not None else None


def minhash(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Classic MinHash signatures: (sets, size) of uint64; EMPTY for empty sets.  The places hash the
    upper 32 bits of the shingles' hashes, which keeps the arrays short."""
    n = len(bounds) - 1
    sig = np.full((n, size), EMPTY)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        at = bounds[:-1][some]
        x = (values >> np.uint64(32)).astype(np.uint32)
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for j in range(size):
                h = (x ^ seeds[2 * j]) * (seeds[2 * j + 1] | np.uint32(1))
                h ^= h >> np.uint32(16)
                h *= np.uint32(0x85EBCA6B)
                sig[some, j] = np.minimum.reduceat(h, at)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) of int64: one hash of each band's rows."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), np.uint64(b + 1))
        for r in range(rows):
            h = mix(h ^ sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def prints(sig: np.ndarray) -> np.ndarray:
    """One byte of each signature value, for estimates that can only be too high."""
    return (mix(sig) >> np.uint64(56)).astype(np.uint8)


def set_digests(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = values.astype("<u8", copy=False)
    return [xxhash.xxh3_128_digest(raw[s:e].data) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each row's slice of values as one binary value."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def packed_sets(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The sets as binary values: their hashes in ascending order, 8 bytes each."""
    return binary_rows(values.astype("<u8", copy=False), bounds)


def set_numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def common_shingles(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two ascending arrays have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
