"""Scans over tiles and blocks against walks over whole sequences."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import genome, scans


def sequences(n: int, length: int, letters: str = "aan ", seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [(f"c{i}", "".join(r.choices(letters, k=r.randint(0, length)))) for i in range(n)] + [("empty", ""), ("null", None)]


@pytest.mark.parametrize("pattern,width", [("[Aa][Nn]", 2), ("aa", 2), ("a.a", 3), ("a", 1)])
@pytest.mark.parametrize("tile", [5, 64, 1 << 16])
def test_matches_across_tiles(spark, pattern, width, tile):
    rows = sequences(25, 90) + [("ties", "a" * 40), ("é", "éaané aan" * 5)]
    df = spark.createDataFrame(rows, "chr string, seq string")
    got = {tuple(r) for r in genome.motif_positions(df, "chr", "seq", pattern, width, tile).collect()}
    want = {(k, n, m.start() + 1) for k, s in rows if s for n, m in enumerate(re.finditer(pattern, s))}
    assert got == want and len(got) > 100


def walk_groups(pos: list[int], min_dist: int) -> list[list[int]]:
    out: list[list[int]] = []
    for p in pos:
        if out and p - out[-1][-1] <= min_dist:
            out[-1].append(p)
        else:
            out.append([p])
    return out


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_groups_across_blocks(spark, block):
    r = random.Random(2)
    sites = {f"c{i}": sorted(r.sample(range(1, 900), r.randint(1, 200))) for i in range(12)} | {"lone": [7], "one": [1, 2, 3, *range(10, 200, 9)]}
    df = spark.createDataFrame([(k, p) for k, v in sites.items() for p in v], "chr string, pos long").repartition(5)
    groups = genome.gap_groups(df, "chr", block=block).cache()
    want = set()
    for k, v in sites.items():
        pad = 5 if len(v) > 1 else 0
        want |= {(k, i, g[0] - pad, g[-1] + pad, len(g), g[0], g[-1]) for i, g in enumerate(walk_groups(v, 10), 1)}
    assert {tuple(x) for x in groups.collect()} == want
    got = {(x.chr, x.grp, x.d_next) for x in genome.group_distances(groups, "chr", block).collect()}
    assert got == {(k, i, b[0] - a[-1] if b else None) for k, v in sites.items() for gs in [walk_groups(v, 10)] for i, (a, b) in enumerate(zip(gs, [*gs[1:], None], strict=True), 1)}
    got = {(x.chr, x.pos, x.d_next) for x in genome.site_distances(df, "chr", block).collect()}
    assert got == {(k, a, b - a if b else None) for k, v in sites.items() for a, b in zip(v, [*v[1:], None], strict=True)}
    got = {(x.chr, x.pos, x.rho) for x in genome.site_density(df, "chr", 50, block).collect()}
    assert got == {(k, p, sum(p - 51 <= x <= p + 48 for x in v) / 100) for k, v in sites.items() for p in v}


def walk_partition(pos: list[int], first: int, last: int, size: int, min_dist: int) -> list[tuple[int, int]]:
    out, i = [], first
    while i < last:
        edge = i + size - 1
        if edge >= last:
            out.append((i, last))
            break
        near = [p for p in pos if edge - 1000 <= p <= min(last, edge + 1000)]
        pad = 5 if len(near) > 1 else 0
        for g in walk_groups(near, min_dist):
            lo, hi = g[0] - pad, g[-1] + pad
            if lo <= edge <= hi:
                edge = hi + 2 if 2 * edge - lo > hi else lo - 1
                break
        out.append((i, edge))
        i = edge + 1
    return out


@pytest.mark.parametrize("min_dist", [1, 10, 60])
@pytest.mark.parametrize("block,size", [(1 << 12, 1100), (1 << 12, 3000), (1 << 16, 3000)])
def test_partition_by_composed_tables(spark, min_dist, block, size):
    """Long chromosomes of many blocks, dense ones whose groups are cut by the context, and empty ones."""
    r = random.Random(min_dist + size)
    sites, ends = {}, {}
    for i, (length, share) in enumerate([(150_000, 0.02), (700_000, 0.05), (90_000, 0.3), (40_000, 0.0), (9_000, 0.01), (2_000, 0.1), (3_000, 0.1), (1, 0.0), (60_000, 0.9)]):
        k, first = f"c{i}", r.choice([1, 1, 5_000])
        ends[k] = (first, first + length - 1)
        sites[k] = sorted(r.sample(range(first, first + length), int(length * share)))
    df = spark.createDataFrame([(k, p) for k, v in sites.items() for p in v], "chr string, pos long")
    sizes = spark.createDataFrame([(k, *v) for k, v in ends.items()], "chr string, first long, last long")
    got = sorted(tuple(x) for x in genome.chromosome_partition(df, sizes, size, min_dist, block).collect())
    def quick(k):  # the walk above, with the sites near an edge found by bisection
        pos, (first, last) = np.asarray(sites[k]), ends[k]
        out, i = [], first
        while i < last:
            e = i + size - 1
            lo, hi = np.searchsorted(pos, [e - 1001, e + 1002])
            part = walk_partition(pos[lo:hi].tolist(), i, last, size, min_dist)[:1]
            out += [(k, *x) for x in part]
            i = out[-1][2] + 1
        return out

    assert got == sorted(x for k in sites for x in quick(k))


def test_one_chromosome_spreads(spark):
    """A key with all rows is searched and scanned by several tasks."""
    df = spark.createDataFrame([("c", "can " * 100_000)], "chr string, seq string")
    cut = scans.tiles(df, "chr", "seq", 1, 1 << 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes go to one task
    try:
        assert cut.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert genome.gap_groups(genome.motif_positions(df, "chr", "seq", "an", 2), "chr", 3).count() == 100_000


def test_region_size_that_could_stand_still(spark):
    with pytest.raises(ValueError):
        genome.chromosome_partition(spark.createDataFrame([], "chr string, pos long"), spark.createDataFrame([], "chr string, first long, last long"), 900)


def test_overlaps_of_any_length(spark):
    """Intervals of all lengths on both sides, repeats, bounds of bins and nulls: pairs are those of two loops."""
    r = random.Random(4)

    def rows(n: int, longest: int) -> list[tuple]:
        out = []
        for i in range(n):
            a = r.choice((r.randrange(200_000), 64 * r.randrange(3000), 4096 * r.randrange(40)))
            out.append((r.choice("ab"), i, a, a + r.choice((0, 1, 63, 64, 511, r.randrange(longest)))))
        return [*out, out[0], ("a", -1, None, 5), ("b", -2, 5, None)]

    left, right = rows(300, 3_000), rows(200, 150_000)
    for one, two in ((left, right), (right, left)):
        p = spark.createDataFrame(one, "c string, x int, p0 long, p1 long")
        q = spark.createDataFrame(two, "c string, y int, i0 long, i1 long")
        got = sorted((h.x, h.y) for h in genome.overlap_join(p, q, "c", "p0", "p1", "i0", "i1", 64).collect())
        want = sorted((x, y) for c, x, a, b in one for k, y, i, j in two if c == k and None not in (a, b, i, j) and a <= j and b >= i)
        assert got == want
    assert genome.overlap_join(p, q.limit(0), "c", "p0", "p1", "i0", "i1", 64).count() == 0
    # an interval over 10^9 bases is a row a level, not a row a bin
    plan = genome.overlap_join(p, spark.createDataFrame([("a", 1, 0, 10**9)], q.schema), "c", "p0", "p1", "i0", "i1", 64)
    assert plan.count() == sum(c == "a" and a is not None and b is not None for c, _, a, b in right)
