"""Hamming distances of many sketches at once, on bit planes.

Sketches of up to 64 rows of a bucket stand side by side in a lane: plane b of the lane is one 64-bit word that has the
rows' bits b.  A probe's bit b, spread over a word, is xor-ed with the plane, which gives the b-th difference of 64 pairs;
carry-save adders sum such words in bit-sliced counters.  Every CHECK planes, blocks of pairs that are all beyond
the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

#: Planes between two looks at who is left, and words that are worked on at once.
CHECK, BLOCK = 32, 1 << 14
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def lanes(bits: np.ndarray, lane: np.ndarray, slot: np.ndarray, n_lanes: int) -> np.ndarray:
    """Planes (bits x lanes) of rows whose bits are given as 0/1 bytes (rows x bits)."""
    planes = np.zeros((bits.shape[1], n_lanes), np.uint64)
    order = np.lexsort((slot, lane))
    lane, slot, bits = lane[order], slot[order], bits[order]
    starts = np.flatnonzero(np.r_[True, np.diff(lane) != 0]) if len(lane) else np.zeros(0, np.int64)
    for b in range(bits.shape[1]):
        if len(starts):
            planes[b, lane[starts]] = np.bitwise_or.reduceat(bits[:, b].astype(np.uint64) << slot.astype(np.uint64), starts)
    return planes


class Counters:
    """Bit-sliced counters of 64 distances a word; counter[i] has bit i of each."""

    def __init__(self, words: int, bits: int):
        self.slices = [np.zeros(words, np.uint64) for _ in range(bits.bit_length())]

    def add(self, carry: np.ndarray, weight: int = 0) -> None:
        """Add 2 ** weight where a bit is set, rippling through the slices."""
        for k in range(weight, len(self.slices)):
            s = self.slices[k]
            self.slices[k] = s ^ carry
            carry = s & carry
            if k % 2 and not carry.any():
                return

    def within(self, radius: int) -> np.ndarray:
        """Bits of the distances that are at most ``radius``, by comparison from the highest slice down."""
        greater, equal = np.zeros_like(self.slices[0]), np.full_like(self.slices[0], _FULL)
        for k in range(len(self.slices) - 1, -1, -1):
            if radius >> k & 1:
                equal &= self.slices[k]
            else:
                greater |= equal & self.slices[k]
                equal &= ~self.slices[k]
        return ~greater

    def keep(self, rows: np.ndarray) -> None:
        self.slices = [s[rows] for s in self.slices]


def close_pairs(planes: np.ndarray, lane: np.ndarray, probe_bits: np.ndarray, probe: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the probe row, index of the word's lane * 64 + slot) of the pairs within the radius.

    Entry i compares row ``probe[i]`` of probe_bits (rows x bits, 0/1) with all slots of ``lane[i]`` that are set in mask[i].
    """
    n_bits = planes.shape[0]
    found_row, found_slot = [], []
    for s in range(0, len(probe), BLOCK):
        rows, at, alive = probe[s : s + BLOCK], lane[s : s + BLOCK], mask[s : s + BLOCK].copy()
        counters = Counters(len(rows), n_bits)
        b = 0
        while b < n_bits and len(rows):
            stop = min(n_bits, b + CHECK)
            while b < stop:
                take = min(3, stop - b)
                d = [planes[b + i][at] ^ (np.uint64(0) - probe_bits[rows, b + i].astype(np.uint64)) for i in range(take)]
                if take == 3:  # carry-save adder: three words of weight 1 become one of weight 1 and one of weight 2
                    half = d[0] ^ d[1]
                    counters.add(half ^ d[2])
                    counters.add(d[0] & d[1] | half & d[2], 1)
                else:
                    for x in d:
                        counters.add(x)
                b += take
            alive &= counters.within(radius)
            left = np.flatnonzero(alive)
            if len(left) < 0.75 * len(rows):
                rows, at, alive = rows[left], at[left], alive[left]
                counters.keep(left)
        for k in range(64):
            hit = np.flatnonzero(alive >> np.uint64(k) & np.uint64(1))
            if len(hit):
                found_row.append(rows[hit])
                found_slot.append(at[hit] * 64 + k)
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_slot)


def bucket_pairs(bucket: np.ndarray, side: np.ndarray, sketch: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of the same bucket whose sketches (rows x bytes) differ in at most ``radius`` bits.

    Rows come sorted by bucket.  Where a bucket has rows of side 0 and of side 1 only pairs across are asked for; a
    bucket whose rows all have side 0 gives all its pairs, i before j.
    """
    n = len(bucket)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    run = np.repeat(np.arange(len(starts)), sizes)
    across = np.add.reduceat(side.astype(np.int64), starts) > 0
    keep = sizes[run] > 1
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    source = np.flatnonzero(keep)
    run, side_, inner = run[source], side[source], (source - starts[run[source]])
    target = np.where(across[run], side_ == 1, True)
    # slots among the targets of the run
    rank = np.cumsum(target) - 1
    first = np.searchsorted(run, run)
    rank = rank - np.where(first > 0, np.cumsum(target)[first - 1], 0)
    n_targets = np.bincount(run, weights=target, minlength=len(starts)).astype(np.int64)
    n_lanes = -(-n_targets // 64)
    lane_start = np.cumsum(n_lanes) - n_lanes
    bits = np.unpackbits(np.ascontiguousarray(sketch[source]), axis=1)
    t = np.flatnonzero(target)
    lane_of, slot_of = lane_start[run[t]] + rank[t] // 64, rank[t] % 64
    planes = lanes(bits[t], lane_of, slot_of, int(n_lanes.sum()))
    back = np.full(int(n_lanes.sum()) * 64, -1, np.int64)
    back[lane_of * 64 + slot_of] = t
    occupied = np.zeros(int(n_lanes.sum()), np.uint64)
    np.bitwise_or.at(occupied, lane_of, np.uint64(1) << slot_of.astype(np.uint64))
    asks = np.flatnonzero(np.where(across[run], side_ == 0, True))
    first_lane = np.where(across[run[asks]], 0, inner[asks] // 64)  # earlier lanes hold earlier rows only
    counts = n_lanes[run[asks]] - first_lane
    probe = np.repeat(asks, counts)
    k = np.arange(len(probe)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_lane, counts)
    lane = lane_start[run[probe]] + k
    mask = occupied[lane]
    own = ~across[run[probe]] & (k == inner[probe] // 64)  # only rows behind the probe
    shift = (inner[probe] % 64).astype(np.uint64)
    behind = np.where(shift == 63, np.uint64(0), _FULL << np.minimum(shift + np.uint64(1), np.uint64(63)))
    mask = np.where(own, mask & behind, mask)
    left, slots = close_pairs(planes, lane, bits, probe, mask, radius)
    return source[left], source[back[slots]]
