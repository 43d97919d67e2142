"""Word n-grams of a batch in an open-addressed NumPy table.

A text's words are runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased.
The words of a batch are copied into one buffer with single spaces, so that every n-gram is a slice of
it.  The slices' xxhash64 is computed for all at once, eight bytes at a time, and the n-grams are
interned: each goes to the place that its hash names and on to the next until it finds itself, hash and
bytes compared, or an empty place.  A place holds the bucket of its n-gram (CRC-32 modulo the number of
buckets, computed once per distinct n-gram) and how often it was met; each occurrence keeps its place's
number, through which values of its bucket are gathered.

N-grams are interned in runs of at most ``MAX_GRAMS``, so a long text takes many small tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


#: Occurrences that one table holds, about 150 bytes each while it is filled.
MAX_GRAMS = 1 << 18
#: N-grams of more bytes are hashed and compared one by one.
LONG = 248

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint8)
    upper = (code >= ord("A")) & (code <= ord("Z"))
    lowered = np.where(upper, code + 32, code).astype(np.uint8)
    digit, letter = (lowered >= ord("0")) & (lowered <= ord("9")), (lowered >= ord("a")) & (lowered <= ord("z"))
    return lowered, digit | letter | (lowered >= 128)


_LOWER, _IN_WORD = _byte_classes()


@dataclass
class Words:
    """The words of texts: their bytes with one space after each, where they start and end, their row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """texts has no nulls.  No word goes across two texts."""
    closed = pa.concat_arrays([pc.binary_join_element_wise(texts, "", "\n")])
    offsets = np.frombuffer(closed.buffers()[1], np.int32)[closed.offset : closed.offset + len(closed) + 1].astype(np.int64)
    raw = np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(closed) and closed.buffers()[2] else np.empty(0, np.uint8)
    raw = _LOWER[raw]
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    first, stop = edges[::2], edges[1::2]
    rows = np.searchsorted(offsets - offsets[0], first, "right") - 1
    # A word is followed by a byte that is in none: at its text's end that is the line end.
    keep = inside.copy()
    keep[stop] = True
    raw[stop] = 32
    length = stop - first
    starts = np.cumsum(length + 1) - length - 1
    return Words(np.concatenate([raw[keep], np.zeros(8, np.uint8)]), starts, starts + length, rows)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as numbers."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def xxh64(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of the slices of data; data has eight bytes more than the slices reach."""
    out = np.empty(len(at), np.uint64)
    long = length > LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + length[k]])
    short = np.flatnonzero(~long)
    if len(short):
        out[short] = _xxh64_short(_lanes(data), data, at[short], length[short])
    return out


def _xxh64_short(lanes: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    size = length.astype(np.uint64)
    h = np.full(len(at), _P5)
    pos = at.copy()
    end = at + length
    wide = np.flatnonzero(length >= 32)
    if len(wide):
        p, stop = pos[wide], end[wide]
        with np.errstate(over="ignore"):
            acc = [np.full(len(wide), v) for v in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        live = np.arange(len(wide))
        while len(live):
            for k in range(4):
                acc[k][live] = _round(acc[k][live], lanes[p[live] + 8 * k])
            p[live] += 32
            live = live[p[live] + 32 <= stop[live]]
        mixed = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for a in acc:
            mixed = (mixed ^ _round(np.uint64(0), a)) * _P1 + _P4
        h[wide] = mixed
        pos[wide] = p
    h += size
    live = np.flatnonzero(pos + 8 <= end)
    while len(live):
        h[live] = _rotate(h[live] ^ _round(np.uint64(0), lanes[pos[live]]), 27) * _P1 + _P4
        pos[live] += 8
        live = live[pos[live] + 8 <= end[live]]
    live = np.flatnonzero(pos + 4 <= end)
    h[live] = _rotate(h[live] ^ (lanes[pos[live]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    pos[live] += 4
    live = np.flatnonzero(pos < end)
    while len(live):
        h[live] = _rotate(h[live] ^ data[pos[live]].astype(np.uint64) * _P5, 11) * _P1
        pos[live] += 1
        live = live[pos[live] < end[live]]
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the slices at a and b of equal length hold the same bytes."""
    lanes = _lanes(data)
    same = a == b
    live = np.flatnonzero(~same & (length <= LONG))
    same[live] = True
    done = 0
    while len(live):
        left = np.minimum(length[live] - done, 8).astype(np.uint64)
        shift = np.uint64(8) * (np.uint64(8) - left)
        equal = ((lanes[a[live] + done] ^ lanes[b[live] + done]) << shift) == 0
        same[live[~equal]] = False
        done += 8
        live = live[equal & (length[live] > done)]
    for k in np.flatnonzero(~same & (length > LONG)).tolist():
        same[k] = np.array_equal(data[a[k] : a[k] + length[k]], data[b[k] : b[k] + length[k]])
    return same


@dataclass
class Table:
    """Interned n-grams: of each place the first occurrence (-1: empty), bucket and count; of each
    occurrence its place."""

    owner: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray


def intern(data: np.ndarray, at: np.ndarray, length: np.ndarray, buckets: int, hashes: np.ndarray | None = None) -> Table:
    """The table of the slices; hashes may be given for a test of colliding ones."""
    n = len(at)
    places = 1 << max(4, (2 * n - 1).bit_length())
    if hashes is None:
        hashes = xxh64(data, at, length)
    owner = np.full(places, -1, np.int64)
    slot = (hashes & np.uint64(places - 1)).astype(np.int64)
    waiting = np.arange(n)
    while len(waiting):
        here = slot[waiting]
        free = owner[here] < 0
        # Of those that meet at an empty place one stays; the others are compared with it.
        owner[here[free]] = waiting[free]
        held = owner[here]
        match = (hashes[held] == hashes[waiting]) & (length[held] == length[waiting])
        like = np.flatnonzero(match)
        match[like] = _same_bytes(data, at[held[like]], at[waiting[like]], length[waiting[like]])
        waiting = waiting[~match]
        slot[waiting] = (slot[waiting] + 1) & (places - 1)
    used = np.flatnonzero(owner >= 0)
    bucket = np.zeros(places, np.int64)
    view = memoryview(data)
    first = owner[used]
    bucket[used] = [zlib.crc32(view[a:b]) % buckets for a, b in zip(at[first].tolist(), (at[first] + length[first]).tolist(), strict=True)]
    return Table(owner, bucket, np.bincount(slot, minlength=places), slot)


def tables(words: Words, n_max: int, buckets: int) -> Iterator[tuple[Table, np.ndarray]]:
    """Tables of all runs of 1 to n_max words of one text, with each occurrence's row."""
    total = len(words.starts)
    step = max(1, MAX_GRAMS // n_max)
    for low in range(0, total, step):
        first = np.arange(low, min(total, low + step))
        at, length, rows = [], [], []
        for n in range(1, n_max + 1):
            begins = first[first + n <= total]
            begins = begins[words.rows[begins + n - 1] == words.rows[begins]]
            at.append(words.starts[begins])
            length.append(words.ends[begins + n - 1] - words.starts[begins])
            rows.append(words.rows[begins])
        at, length, rows = map(np.concatenate, (at, length, rows))
        yield intern(words.data, at, length, buckets), rows
