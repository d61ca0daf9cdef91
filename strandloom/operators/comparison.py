"""Permutation tests between groups and false-discovery rates, in DataFrame operators."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.config import LMAX
from strandloom.session import settled

#: Statistics that differ by less, relative to theirs over 1, are tied.
TIE = 1e-12


def masks(n: int, k: int, lmax: int = LMAX, seed: int = 17) -> tuple[list[int], int, bool]:
    """(masks, denominator, exact) of the relabellings of k among n; no masks where p can't be small.

    At most ``lmax`` masks: enumerated if there are fewer, else random ones with repeats dropped.
    """
    total = comb(n, k)
    if total <= 20:
        return [], total, True
    if total < lmax:
        return [sum(1 << i for i in c) for c in combinations(range(n), k)], total, True
    rng = np.random.default_rng(seed)
    rows = sorted({sum(1 << int(i) for i in rng.choice(n, k, replace=False)) for _ in range(lmax)})
    return rows, len(rows) + 1, False


def with_masks(df: DataFrame, lmax: int = LMAX) -> DataFrame:
    """Adds masks (array), denominator, exact to rows with n and n1: by a join with a row for each
    pair of numbers of replicates that occurs, of which there are at most replicates squared."""
    shapes = [(r["n"], r["n1"]) for r in df.select(F.col("n").cast("int").alias("n"), F.col("n1").cast("int").alias("n1")).distinct().collect()]
    table = df.sparkSession.createDataFrame([(n, n1, *masks(n, n1, lmax)) for n, n1 in shapes], "m_n int, m_n1 int, masks array<long>, denominator int, exact boolean")
    return df.join(F.broadcast(table), (F.col("n") == F.col("m_n")) & (F.col("n1") == F.col("m_n1"))).drop("m_n", "m_n1")


def p_of_hits(hits: Column) -> Column:
    """p of rows of ``with_masks``; null where there are no masks."""
    return F.when(F.size("masks") > 0, (hits + F.when(F.col("exact"), 0).otherwise(1)) / F.col("denominator"))


def unmatched_test(values: DataFrame, keys: list[str], lmax: int = LMAX) -> DataFrame:
    """keys, stat, p: difference of group means of ``x`` with p by relabelling.

    ``values``: keys, grp (1 or 2), i (place among all of a key, from 0), x. Relabellings are
    folded inside the row of a key: none is a row of its own.
    """
    shape = values.groupBy(*keys).agg(F.sum((F.col("grp") == 1).cast("int")).alias("n1"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("i", "x", "grp")).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.sort_array("v")
    both = shape.where("n1 > 0 and n1 < n").withColumns({"v": F.transform(v, lambda r: r.x), "s1": total(F.transform(F.filter(v, lambda r: r.grp == 1), lambda r: r.x))})
    both = both.withColumn("s", total(F.col("v")))
    mean_gap = lambda s1: s1 / F.col("n1") - (F.col("s") - s1) / (F.col("n") - F.col("n1"))
    both = with_masks(both.withColumn("stat", mean_gap(F.col("s1"))), lmax)
    least = F.abs(F.col("stat")) - TIE * F.greatest(F.lit(1.0), F.abs(F.col("stat")))
    chosen = lambda m: total(F.transform("v", lambda x, i: F.when(m.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, x).otherwise(0.0)))
    hits = F.size(F.filter("masks", lambda m: F.abs(mean_gap(chosen(m))) >= least))
    return both.select(*keys, "stat", p_of_hits(hits).alias("p"))


def divergence_test(cmd: DataFrame, members: DataFrame, keys: list[str], lmax: int = LMAX) -> DataFrame:
    """keys, stat, p: mean divergence over the pairs of one replicate of each group, p by relabelling.

    ``cmd``: keys, i, j, cmd of all pairs of replicates; ``members``: keys, sample, grp, a row for
    each replicate that a key has. Keys are tested with their own numbers of replicates: where
    some are missing there are fewer relabellings, and none if 20 or fewer. One-sided.
    """
    order = F.sort_array(F.collect_list(F.struct("grp", "sample")))
    own = members.groupBy(*keys).agg(order.alias("m")).withColumns({"n": F.size("m"), "n1": F.size(F.filter("m", lambda r: r.grp == 1)), "at": F.transform("m", lambda r: r["sample"])})
    pairs = cmd.groupBy(*[F.col(k).alias(f"c_{k}") for k in keys]).agg(F.collect_list(F.struct("i", "j", "cmd")).alias("c"))
    same = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    place = lambda x: (F.array_position(F.col("at"), x) - 1).cast("int")
    both = own.where("n1 > 0 and n1 < n").join(pairs, on).withColumn("c", F.transform("c", lambda r: F.struct(place(r.i).alias("a"), place(r.j).alias("b"), r.cmd.alias("x")))).withColumn("c", F.filter("c", lambda r: (r.a >= 0) & (r.b >= 0)))

    def mean(mask: Column) -> Column:
        bit = lambda i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0
        apart = F.filter("c", lambda r: bit(r.a) != bit(r.b))
        return F.when(F.size(apart) > 0, F.aggregate(apart, F.lit(0.0), lambda s, r: s + r.x) / F.size(apart))

    first = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n1")) - 1  # the first group's replicates come first
    both = with_masks(both.withColumn("stat", mean(first)).where("stat is not null"), lmax)
    hits = F.size(F.filter("masks", lambda m: mean(m) >= F.col("stat") - TIE))
    return both.select(*keys, "stat", p_of_hits(hits).alias("p"))


def matched_test(pairs: DataFrame, keys: list[str], lmax: int = LMAX, seed: int = 17) -> DataFrame:
    """keys, stat, p: mean of the paired differences ``x`` (pair numbers ``i`` from 0), p by sign flips.

    Flips are folded inside the row of a key: none is a row of its own. Of all flips half are tried,
    as a flip and its mirror image reach the same size.
    """
    shape = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.avg("x").alias("stat")).withColumn("n", F.size("v"))
    exact = (F.pow(F.lit(2.0), F.col("n")) < lmax) & (F.col("n") < 31)
    half = F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, greatest(least(n, 30) - 1, 0))") - 1)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(lmax)), lambda k: F.pmod(F.xxhash64(k, F.lit(seed)), F.expr("shiftleft(1L, least(n, 62))")))
    flips = F.when(F.pow(F.lit(0.5), F.col("n")) >= 0.05, F.array().cast("array<long>")).when(exact, half).otherwise(drawn)
    size = F.abs(F.col("stat"))
    done = shape.withColumns({"flips": flips, "least": size - TIE * F.greatest(F.lit(1.0), size), "exact": exact})
    flipped = "aggregate(transform(v, (r, i) -> if(shiftright(j, i) & 1 = 1, r.x, -r.x)), 0D, (s, t) -> s + t)"
    hits, tried = F.expr(f"size(filter(flips, j -> abs({flipped} / n) >= least))"), F.size("flips")
    p = F.when(F.col("exact"), hits / tried).otherwise((hits + 1) / (tried + 1))
    return done.select(*keys, "stat", F.when(tried > 0, p).alias("p"))


def mean_divergence(cmd: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stat: mean of the matched pairs' divergences (rows of ``cmd``)."""
    return cmd.groupBy(*keys).agg(F.avg("cmd").alias("stat"))


def group_pairs(models: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j: each replicate of group 1 with each of group 2 of the same key (keys, sample, grp)."""
    side = lambda g, x: models.where(F.col("grp") == g).select(*keys, F.col("sample").alias(x))
    return side(1, "i").join(side(2, "j"), keys)


def bh(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Adds q: Benjamini-Hochberg within ``keys`` (a test); null p have null q.

    q(p) depends on distinct p alone. They are cut into ranges in order of (keys, p), a range a task,
    and written once, as they are read thrice. Ranks are carried from range to range, and least
    ratios back, over a row a range, so no window holds a test; results don't depend on the cuts.
    """
    # names of their own: a key may be called like a column made here
    named = [f"__k{i}" for i in range(len(keys))]
    counts = df.where(F.col(p).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    ranges = settled(counts.repartitionByRange(*named, "__p").withColumn("__b", F.spark_partition_id()))
    inside, over = W.partitionBy(*named, "__b").orderBy("__p"), W.partitionBy(*named) if named else W.partitionBy(F.lit(1))
    order, until, since = over.orderBy("__b"), (W.unboundedPreceding, W.currentRow), (W.currentRow, W.unboundedFollowing)

    def joined(rows: DataFrame, by_range: DataFrame) -> DataFrame:
        """``rows`` with the columns of their range; keys may be null."""
        there = by_range.select(*[F.col(n).alias(f"{n}_") for n in named], F.col("__b").alias("__b_"), *[c for c in by_range.columns if c not in (*named, "__b")])
        on = F.col("__b") == F.col("__b_")
        for n in named:
            on = on & F.col(n).eqNullSafe(F.col(f"{n}_"))
        return rows.join(there, on).drop("__b_", *[f"{n}_" for n in named])

    sums = ranges.groupBy(*named, "__b").agg(F.sum("__n").alias("__in"))
    carry = sums.select(*named, "__b", (F.sum("__in").over(order.rowsBetween(*until)) - F.col("__in")).alias("__ahead"), F.sum("__in").over(over).alias("__m"))
    rank = F.col("__ahead") + F.sum("__n").over(inside.rowsBetween(*until))
    ratio = joined(ranges, carry).withColumn("__r", F.col("__p") * F.col("__m") / rank).select(*named, "__b", "__p", "__r")
    least = ratio.groupBy(*named, "__b").agg(F.min("__r").alias("__least"))
    later = least.select(*named, "__b", F.min("__least").over(order.rowsBetween(1, W.unboundedFollowing)).alias("__later"))
    q = F.least(F.lit(1.0), F.min("__r").over(inside.rowsBetween(*since)), F.col("__later"))
    of_p = joined(ratio, later).select(*named, "__p", q.alias("q"))
    on = F.col(p) == F.col("__p")
    for k, n in zip(keys, named, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(of_p, on, "left").drop("__p", *named)


def common_keys(values: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a replicate in each group."""
    return values.groupBy(*keys).agg(F.max((F.col("grp") == 1).cast("int")).alias("a"), F.max((F.col("grp") == 2).cast("int")).alias("b")).where("a = 1 and b = 1").select(*keys)


def exclusive_keys(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, grp of the keys whose replicates are all of one group."""
    return values.groupBy(*keys).agg(F.min("grp").alias("grp"), F.max("grp").alias("other")).where(F.col("grp") == F.col("other")).drop("other")
