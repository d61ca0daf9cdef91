"""Regions of many blocks at once: as many steps as a block has bounds, whatever its characters."""

from __future__ import annotations

import numpy as np

from strandloom.operators import genome


def _plain(begin, entry, first, last, pos, size, min_dist, block):
    e, out = max(first + size - 1, begin + entry), []
    while True:
        if e >= last:
            return out + ([(e - size + 1, last)] if e - size + 1 < last else [])
        if e >= begin + block:
            return out
        bound = int(genome._edges(np.asarray([e]), pos, last, genome._group_ends(pos, min_dist))[0])
        out.append((e - size + 1, bound))
        e = bound + size


def test_blocks_at_once_equal_one_at_a_time(monkeypatch):
    r = np.random.default_rng(11)
    size, min_dist, block = 1100, 10, 1 << 14
    rows = []
    for _ in range(200):
        k = int(r.integers(0, 4))
        first, last = 1, int(r.integers(2, 60_000))
        if k * block >= last:
            k = 0
        begin = k * block
        lo, hi = max(1, begin - 1011), min(last, begin + block + 1011)
        gaps = np.cumsum(r.choice([2, 3, 9, 40, 700], size=int(r.integers(0, 400)), p=[0.4, 0.3, 0.2, 0.09, 0.01]))
        pos = lo + gaps[gaps < hi - lo]
        rows.append((begin, int(r.integers(0, size)) if k else 0, first, last, pos))
    calls, real = [], genome._edges
    monkeypatch.setattr(genome, "_edges", lambda e, *a: calls.append(len(e)) or real(e, *a))
    columns = [np.asarray(c, np.int64) for c in list(zip(*rows, strict=True))[:4]]
    at = np.concatenate([r.permutation(x[4]) for x in rows])
    row, start, end = genome._regions(*columns, at, np.asarray([len(x[4]) for x in rows]), size, min_dist, block)
    assert len(calls) <= block // 90 and sum(calls) <= len(row)  # places looked at: bounds alone
    got = [[] for _ in rows]
    for i, a, b in sorted(zip(row.tolist(), start.tolist(), end.tolist(), strict=True)):
        got[i].append((a, b))
    assert got == [_plain(*x, size, min_dist, block) for x in rows]
    assert all(not len(x) for x in genome._regions(*[np.zeros(0, np.int64)] * 6, size, min_dist, block))
