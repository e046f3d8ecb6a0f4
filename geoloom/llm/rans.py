"""Static range asymmetric numeral system over numpy arrays.

A segment of token ids shares one frequency table. It is cut into independent blocks; a block's tokens are dealt to 32
interleaved coders ("lanes") which share the block's stream of 32-bit words. Each block keeps its place in the stream
and the states from which it decodes (its checkpoint), and a checksum of its tokens.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES = 32
BLOCK = 32768
#: Frequencies sum to a power of two, at least 2**14 and four slots a symbol; states stay in [2**31, 2**63).
LEAST_SCALE, SPARE_SCALE = 14, 2
_LOW, _W, _MASK = np.uint64(1 << 31), np.uint64(32), np.uint64(0xFFFFFFFF)


@dataclass
class Segment:
    """``symbols`` and ``counts``: the table; ``tokens, words, crcs``: of each block; ``states``: blocks by lanes."""

    symbols: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    crcs: np.ndarray
    states: np.ndarray
    payload: np.ndarray


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to a power of two; what rounding leaves goes to the commonest symbol."""
    whole = 1 << max(LEAST_SCALE, int(len(counts) - 1).bit_length() + SPARE_SCALE)
    spare = whole - len(counts)
    f = 1 + (counts.astype(np.uint64) * np.uint64(spare) // np.uint64(counts.sum())).astype(np.int64)
    f[np.argmax(counts)] += whole - f.sum()
    return f.astype(np.uint32)


def encode(ids: np.ndarray) -> Segment:
    """Encode token ids (non-negative, under 2**31) as one segment."""
    n = len(ids)
    tally = np.bincount(ids) if n else np.zeros(0, np.int64)
    symbols = np.flatnonzero(tally)
    counts, place = tally[symbols], np.zeros(len(tally), np.int32)
    place[symbols] = np.arange(len(symbols))
    codes = place[ids]
    empty = np.zeros(0, np.uint32)
    if not n:
        return Segment(empty, empty, empty, empty, empty, np.zeros((0, LANES), np.uint64), empty)
    freq = scaled(counts)
    f64 = freq.astype(np.uint64)
    scale = int(freq.sum()).bit_length() - 1
    shift, limit = np.uint64(scale), f64 << np.uint64(63 - scale)
    cum = np.concatenate(([0], np.cumsum(f64)[:-1])).astype(np.uint64)
    blocks = -(-n // BLOCK)
    tokens = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    crcs = np.array([zlib.crc32(ids[b * BLOCK : b * BLOCK + t].astype("<u4").tobytes()) for b, t in enumerate(tokens)], np.uint32)
    steps = -(-min(n, BLOCK) // LANES)
    grid = np.zeros(blocks * BLOCK if blocks > 1 else steps * LANES, np.int32)
    grid[:n] = codes
    # Padding is the commonest symbol: it costs least, and the reader drops it.
    grid[n:] = int(np.argmax(counts))
    grid = np.ascontiguousarray(grid.reshape(blocks, -1, LANES).transpose(1, 0, 2).reshape(-1, blocks * LANES))
    x = np.full(blocks * LANES, _LOW)
    out, where = [], []
    for row in grid[::-1]:
        f = f64[row]
        full = np.flatnonzero(x >= limit[row])
        if len(full):
            out.append((x[full] & _MASK).astype(np.uint32))
            where.append(full)
            x[full] >>= _W
        q = x // f
        x = (q << shift) + (x - q * f) + cum[row]
    if out:
        payload, lane = np.concatenate(out[::-1]), np.concatenate(where[::-1])
        block = (lane // LANES).astype(np.uint16 if blocks < 65536 else np.int64)
        payload = payload[np.argsort(block, kind="stable")]
        words = np.bincount(block, minlength=blocks)
    else:
        payload, words = empty, np.zeros(blocks, np.int64)
    return Segment(symbols.astype(np.uint32), freq, tokens.astype(np.uint32), words.astype(np.uint32), crcs, x.reshape(blocks, LANES), payload)


def decode(s: Segment, first: int = 0, last: int | None = None) -> np.ndarray:
    """The token ids of blocks ``first`` up to ``last``; any blocks decode without the others."""
    tokens = s.tokens[first:last].astype(np.int64)
    blocks = len(tokens)
    if not blocks:
        return np.zeros(0, np.uint32)
    f64 = s.counts.astype(np.uint64)
    cum = np.concatenate(([0], np.cumsum(f64)[:-1])).astype(np.uint64)
    slots = np.repeat(np.arange(len(s.counts), dtype=np.int32), s.counts)
    scale = len(slots).bit_length() - 1
    shift, mask = np.uint64(scale), np.uint64((1 << scale) - 1)
    factor, rest = f64[slots], np.arange(len(slots), dtype=np.uint64) - cum[slots]
    at = np.concatenate(([0], np.cumsum(s.words.astype(np.int64))))[first : first + blocks].copy()
    x = s.states[first:last].reshape(-1).copy()
    steps = BLOCK // LANES if len(s.tokens) > 1 else -(-int(s.tokens[0]) // LANES)
    grid = np.empty((steps, blocks * LANES), np.int32)
    payload = s.payload.astype(np.uint64)
    for k in range(steps):
        slot = (x & mask).view(np.int64)
        grid[k] = slots[slot]
        x = factor[slot] * (x >> shift) + rest[slot]
        full = np.flatnonzero(x < _LOW)
        if len(full):
            # Within a step the lanes of a block read their words in order.
            own = np.bincount(full // LANES, minlength=blocks)
            before = np.cumsum(own) - own
            x[full] = (x[full] << _W) | payload[np.arange(len(full)) + np.repeat(at - before, own)]
            at += own
    flat = grid.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)
    out = [s.symbols[flat[b, : tokens[b]]] for b in range(blocks)]
    for b, ids in enumerate(out):
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(s.crcs[first + b]):
            raise ValueError(f"block {first + b} doesn't match its checksum")
    return np.concatenate(out)
