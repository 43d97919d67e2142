"""A static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

A block holds up to STEPS x LANES ids.  Lane k codes ids k, k + LANES, ...; all lanes of a block
share one stream of 32-bit words.  States are 64 bits in [2^31, 2^63), frequencies sum to 2^20.
Every SEGMENT steps a checkpoint keeps the word offset and all lane states, so that segments decode
independently of each other; the decoder runs many of them side by side.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
SCALE = 1 << SCALE_BITS
LANES, STEPS, SEGMENT = 64, 1024, 256
BLOCK = LANES * STEPS
_LOW = np.uint64(1 << 31)
_B32, _BITS = np.uint64(32), np.uint64(SCALE_BITS)


class CorruptBlock(ValueError):
    """A checksum does not match."""


@dataclass
class Table:
    """Symbols with their scaled frequencies, shared by all blocks."""

    symbols: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        if int(self.freq.sum()) != SCALE:
            raise ValueError("frequencies do not sum to the scale")
        cum = np.cumsum(self.freq) - self.freq
        top = int(self.symbols.max()) + 1
        self.freq_of, self.cum_of = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq_of[self.symbols], self.cum_of[self.symbols] = self.freq, cum
        self.slot = np.repeat(self.symbols.astype(np.uint32), self.freq)

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Scaled frequencies, at least 1 each; what rounding leaves goes to the most frequent."""
        if not len(symbols):
            symbols, counts = np.zeros(1, np.int64), np.ones(1, np.int64)
        if len(symbols) > SCALE // 2:
            raise ValueError("too many symbols for the scale")
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols, np.int64)[order], np.asarray(counts, np.float64)[order]
        freq = np.maximum(1, np.floor(counts * ((SCALE - len(symbols)) / counts.sum())).astype(np.int64))
        freq[np.argmax(counts)] += SCALE - freq.sum()
        return cls(symbols, freq)

    def to_bytes(self) -> bytes:
        body = struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise CorruptBlock("frequency table")
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64))


def _encode_equal(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids (blocks, steps, LANES): per block (words, word offset and lane states by segment)."""
    blocks, steps, _ = ids.shape
    state = np.full((blocks, LANES), _LOW)
    words, out = np.empty((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    kept = np.empty((-(-steps // SEGMENT), blocks, LANES), np.uint64)
    limit = np.uint64(63 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        s = ids[:, t]
        f = table.freq_of[s]
        full = state >= (f << limit)
        out[t] = full
        words[t] = state  # the low 32 bits
        state = np.where(full, state >> _B32, state)
        q = state // f
        state = (q << _BITS) + (state - q * f) + table.cum_of[s]
        if t % SEGMENT == 0:
            kept[t // SEGMENT] = state
    made = []
    for b in range(blocks):
        mask = out[:, b]
        before = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
        made.append((words[:, b][mask], before[:-1][::SEGMENT].astype(np.uint32), kept[:, b]))
    return made


_HEAD, _HEAD_SIZE = "<IIIII", 20  # ids, words, segments, CRC-32 of the ids, CRC-32 of the rest


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of BLOCK ids, the last one shorter."""
    if not len(ids):
        return []
    whole = len(ids) // BLOCK
    parts = [(ids[: whole * BLOCK].reshape(whole, STEPS, LANES), [BLOCK] * whole)] if whole else []
    rest = ids[whole * BLOCK :]
    if len(rest):
        steps = -(-len(rest) // LANES)
        padded = np.full(steps * LANES, table.symbols[0], np.uint32)
        padded[: len(rest)] = rest
        parts.append((padded.reshape(1, steps, LANES), [len(rest)]))
    made, at = [], 0
    for block_ids, counts in parts:
        for (words, offsets, states), n in zip(_encode_equal(block_ids, table), counts, strict=True):
            body = offsets.astype("<u4").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            crc = zlib.crc32(ids[at : at + n].astype("<u4", copy=False).tobytes())
            made.append(struct.pack(_HEAD, n, len(words), len(offsets), crc, zlib.crc32(body)) + body)
            at += n
    return made


@dataclass
class _Segment:
    block: int
    first: int
    steps: int
    words: np.ndarray
    states: np.ndarray


def _open(raw: bytes, number: int) -> tuple[int, int, list[_Segment]]:
    n, words, segments, crc, body_crc = struct.unpack_from(_HEAD, raw)
    if len(raw) != _HEAD_SIZE + segments * (4 + 8 * LANES) + 4 * words or zlib.crc32(raw[_HEAD_SIZE :]) != body_crc:
        raise CorruptBlock(f"block {number}")
    offsets = np.frombuffer(raw, "<u4", segments, _HEAD_SIZE).astype(np.int64)
    states = np.frombuffer(raw, "<u8", segments * LANES, _HEAD_SIZE + 4 * segments).reshape(segments, LANES)
    stream = np.frombuffer(raw, "<u4", words, len(raw) - 4 * words)
    steps = -(-n // LANES)
    ends = np.append(offsets[1:], words)
    return n, crc, [_Segment(number, k * SEGMENT, min(SEGMENT, steps - k * SEGMENT), stream[offsets[k] : ends[k]], states[k]) for k in range(segments)]


def _decode_equal(segments: list[_Segment], table: Table) -> np.ndarray:
    """Segments of equal steps: ids (segments, steps, LANES)."""
    steps = segments[0].steps
    state = np.stack([s.states for s in segments]).astype(np.uint64)
    stream = np.concatenate([*(s.words for s in segments), np.zeros(1, np.uint32)]).astype(np.uint64)
    sizes = np.array([len(s.words) for s in segments])
    at = np.cumsum(sizes) - sizes
    out = np.empty((steps, len(segments), LANES), np.uint32)
    mask = np.uint64(SCALE - 1)
    for t in range(steps):
        slot = state & mask
        s = table.slot[slot]
        out[t] = s
        state = table.freq_of[s] * (state >> _BITS) + slot - table.cum_of[s]
        low = state < _LOW
        upto = np.cumsum(low, axis=1)
        index = np.minimum(at[:, None] + upto - 1, len(stream) - 1)
        state = np.where(low, (state << _B32) | stream[index], state)
        at = at + upto[:, -1]
    return out.transpose(1, 0, 2)


def decode_blocks(blocks: list[bytes], table: Table, side_by_side: int = 256) -> np.ndarray:
    """The ids of all blocks; CorruptBlock where a checksum does not match."""
    opened = [_open(raw, k) for k, raw in enumerate(blocks)]
    ids = [np.empty(-(-n // LANES) * LANES, np.uint32) for n, _, _ in opened]
    by_steps: dict[int, list[_Segment]] = {}
    for _, _, segments in opened:
        for s in segments:
            by_steps.setdefault(s.steps, []).append(s)
    for same in by_steps.values():
        for k in range(0, len(same), side_by_side):
            run = same[k : k + side_by_side]
            for s, got in zip(run, _decode_equal(run, table), strict=True):
                ids[s.block][s.first * LANES : s.first * LANES + got.size] = got.ravel()
    for k, (n, crc, _) in enumerate(opened):
        ids[k] = ids[k][:n]
        if zlib.crc32(ids[k].astype("<u4", copy=False).tobytes()) != crc:
            raise CorruptBlock(f"ids of block {k}")
    return np.concatenate(ids) if ids else np.empty(0, np.uint32)
