import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.llm.bitslice import Counters, bucket_pairs


@given(st.integers(0, 2**32), st.integers(2, 300), st.integers(1, 20), st.integers(0, 192))
@settings(max_examples=40, deadline=None)
def test_pairs_are_those_of_a_plain_comparison(seed, n, buckets, radius):
    rng = np.random.default_rng(seed)
    bucket = np.sort(rng.integers(0, buckets, n))
    side = (rng.random(buckets) < 0.4)[bucket] * rng.integers(0, 2, n)
    sketch = rng.integers(0, 256, (buckets, 24), dtype=np.uint8)[bucket] ^ np.packbits(rng.random((n, 192)) < rng.choice([0.01, 0.1, 0.4], n)[:, None], axis=1)
    i, j = bucket_pairs(bucket, side, sketch, radius)
    got = set(zip(i.tolist(), j.tolist()))
    assert len(got) == len(i)
    bits = np.unpackbits(sketch, axis=1).astype(int)
    expected = set()
    for b in range(buckets):
        rows = np.flatnonzero(bucket == b)
        pairs = [(x, y) for x in rows for y in rows if (side[x] == 0 and side[y] == 1 if side[rows].any() else x < y)]
        expected |= {(int(x), int(y)) for x, y in pairs if np.abs(bits[x] - bits[y]).sum() <= radius}
    assert got == expected


def test_counters_count():
    rng = np.random.default_rng(0)
    c, total = Counters(3, 192), np.zeros((3, 64), int)
    for _ in range(150):
        w = rng.integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3, dtype=np.uint64)
        c.add(w)
        total += (w[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(int)
    for radius in (0, 60, 75, 80, 150, 192):
        got = c.within(radius)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        assert (got.astype(bool) == (total <= radius)).all()


def test_nothing():
    assert len(bucket_pairs(np.zeros(0, int), np.zeros(0, int), np.zeros((0, 24), np.uint8), 5)[0]) == 0
