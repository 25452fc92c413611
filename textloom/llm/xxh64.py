"""XXH64 of many spans of one byte string at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans of more bytes are hashed one by one.
LONG = 1024


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _lane(value: np.ndarray, state: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _turned(state + value * P2, 31) * P1


def span_digests(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The unsigned XXH64 of ``data[start:end]`` for all spans."""
    sizes = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    long = np.flatnonzero(sizes > LONG)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], seed)
    # by size, so that those which take another step are always the last ones
    order = np.argsort(sizes, kind="stable")[: len(starts) - len(long)]
    if not len(order):
        return out
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    at, size = starts[order], sizes[order]
    h = np.full(len(order), np.uint64(seed) + P5, dtype=np.uint64)
    with np.errstate(over="ignore"):
        first = int(np.searchsorted(size, 32))
        if first < len(order):
            n, place = size[first:], at[first:]
            begin = np.uint64(seed)
            lanes = np.array([begin + P1 + P2, begin + P2, begin, begin - P1], dtype=np.uint64)[:, None].repeat(len(n), axis=1)
            for step in range(int(n[-1]) // 32):
                k = int(np.searchsorted(n, 32 * (step + 1)))
                for lane in range(4):
                    lanes[lane, k:] = _lane(eight[place[k:] + (32 * step + 8 * lane)], lanes[lane, k:])
            mixed = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for lane in range(4):
                mixed = (mixed ^ _lane(lanes[lane])) * P1 + P4
            h[first:] = mixed
        h += size.astype(np.uint64)
        at, left = at + size // 32 * 32, size % 32
        for _ in range(3):
            k = np.flatnonzero(left >= 8)
            h[k] = _turned(h[k] ^ _lane(eight[at[k]]), 27) * P1 + P4
            at[k] += 8
            left[k] -= 8
        k = np.flatnonzero(left >= 4)
        h[k] = _turned(h[k] ^ ((eight[at[k]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[k] += 4
        left[k] -= 4
        for _ in range(3):
            k = np.flatnonzero(left > 0)
            h[k] = _turned(h[k] ^ (raw[at[k]].astype(np.uint64) * P5), 11) * P1
            at[k] += 1
            left[k] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[order] = h ^ (h >> np.uint64(32))
    return out
