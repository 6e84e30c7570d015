"""XXH64 of many byte ranges of one buffer at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the published XXH64 definition.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mix(lane: np.ndarray) -> np.ndarray:
    return _rotate(lane * P2, 31) * P1


#: Ranges beyond this many bytes are few; the library hashes them one by one.
LONG = 1 << 12
#: Bytes that a buffer needs after its last range; one that has them isn't copied.
SPARE = 8


def hash_ranges(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of buffer[start:start+length] for every range. Ranges may overlap."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    if int(lengths.max()) > LONG:
        out = np.zeros(n, np.uint64)
        short = lengths <= LONG
        out[short] = hash_ranges(buffer, starts[short], lengths[short], seed)
        for i in np.flatnonzero(~short).tolist():
            out[i] = xxhash.xxh64_intdigest(buffer[starts[i] : starts[i] + lengths[i]].tobytes(), seed)
        return out
    padded = buffer
    if int((starts + lengths).max()) + SPARE > len(buffer):
        padded = np.zeros(len(buffer) + SPARE, np.uint8)
        padded[: len(buffer)] = buffer
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    seed64, at, left = np.uint64(seed), starts.astype(np.int64), lengths.astype(np.int64)
    out = np.full(n, seed64 + P5, np.uint64)
    long = np.flatnonzero(left >= 32)
    with np.errstate(over="ignore"):
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            here, stripes = at[long], left[long] // 32
            live = np.arange(len(long))
            step = 0
            while len(live):
                for k in range(4):
                    lanes[k][live] = _rotate(lanes[k][live] + eight[here[live] + 32 * step + 8 * k] * P2, 31) * P1
                step += 1
                live = live[stripes[live] > step]
            h = sum((_rotate(lane, by) for lane, by in zip(lanes[1:], (7, 12, 18))), _rotate(lanes[0], 1))
            for lane in lanes:
                h = (h ^ _mix(lane)) * P1 + P4
            out[long] = h
            at[long] += 32 * stripes
            left[long] -= 32 * stripes
        out += lengths.astype(np.uint64)
        for _ in range(3):
            rows = np.flatnonzero(left >= 8)
            if not len(rows):
                break
            out[rows] = _rotate(out[rows] ^ _mix(eight[at[rows]]), 27) * P1 + P4
            at[rows] += 8
            left[rows] -= 8
        rows = np.flatnonzero(left >= 4)
        out[rows] = _rotate(out[rows] ^ (four[at[rows]].astype(np.uint64) * P1), 23) * P2 + P3
        at[rows] += 4
        left[rows] -= 4
        for _ in range(3):
            rows = np.flatnonzero(left > 0)
            if not len(rows):
                break
            out[rows] = _rotate(out[rows] ^ (padded[at[rows]].astype(np.uint64) * P5), 11) * P1
            at[rows] += 1
            left[rows] -= 1
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        return out ^ (out >> np.uint64(32))
