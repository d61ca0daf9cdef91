"""Scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def alpha_from_ex(ex: Column) -> Column:
    """atanh clamped to [-20, 20]; null stays null."""
    return F.when(ex.isNull(), F.lit(None).cast("double")).when(ex >= 1, F.lit(20.0)).when(ex <= -1, F.lit(-20.0)).otherwise(F.least(F.greatest(0.5 * F.log((1 + ex) / (1 - ex)), F.lit(-20.0)), F.lit(20.0)))


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def binary_entropy(p: Column) -> Column:
    part = lambda x: x * F.log2(F.greatest(x, F.lit(EPS)))
    return -(part(p) + part(1 - p))


def binarise(m: Column, u: Column, wrong: float = -50.0, right: float = 0.0) -> tuple[Column, Column]:
    """(log p of methylated, of unmethylated) of a call taken as certain; a tie is unmethylated."""
    return F.when(m > u, right).otherwise(wrong), F.when(m > u, wrong).otherwise(right)


def call_sign(m: Column, u: Column) -> Column:
    return F.when(m > u, 1).otherwise(-1)


def strand(paired: Column, flag1: Column, flag2: Column | None = None) -> Column:
    """OT, OB, CTOT or CTOB by the flag of an alignment, or those of both mates in order; others raise."""
    flag2 = F.lit(None).cast("int") if flag2 is None else flag2
    single = F.when(flag1 == 0, "OT").when(flag1 == 16, "OB")
    mates = lambda a, b: (flag1 == a) & (flag2 == b)
    double = F.when(mates(99, 147), "OT").when(mates(83, 163), "OB").when(mates(147, 99), "CTOT").when(mates(163, 83), "CTOB")
    known = F.when(paired, double).otherwise(single)
    return F.when(known.isNull(), F.raise_error(F.concat_ws(" ", F.lit("unexpected flag"), flag1.cast("string"), flag2.cast("string"))).cast("string")).otherwise(known)


def parse_range(text: Column) -> Column:
    """start and end of ``"a:b"``; null if it isn't one."""
    part = lambda i: F.split(text, ":")[i].try_cast("long")
    return F.when(F.size(F.split(text, ":")) == 2, F.struct(part(0).alias("start"), part(1).alias("end")))


def product_moment(ex: Column, next_ex: Column, exx: Column) -> Column:
    """E[YY'] of y = (x + 1) / 2 from moments of x, kept in [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.25 * (exx + ex + next_ex + 1)))


def site_correlation(ex: Column, next_ex: Column, exx: Column) -> Column:
    """Pearson correlation of neighbours in {-1, 1}; null where one of them is certain."""
    sd = F.sqrt(1 - ex * ex) * F.sqrt(1 - next_ex * next_ex)
    return F.when(sd > 0, (exx - ex * next_ex) / sd)


def link(a: Column, b: Column, c: Column, n: Column, rho: Column, d: Column) -> tuple[Column, Column]:
    """(alpha, beta) of a group of n sites with density rho and distance d to the next."""
    return n * (a + b * rho), c / d


def ising_log_z(alpha: Column, beta: Column) -> Column:
    """log Z of a chain from arrays of N fields and N - 1 couplings: a fold in the JVM."""
    first = F.element_at(alpha, 1)
    start = F.struct((-first).alias("m"), first.alias("p"), F.lit(1).alias("i"))
    rest = F.slice(alpha, 2, F.greatest(F.size(alpha) - 1, F.lit(0)))

    def step(acc: Column, a: Column) -> Column:
        b = F.element_at(beta, acc.i)
        m = log_sum_exp(acc.m + b, acc.p - b) - a
        p = log_sum_exp(acc.m - b, acc.p + b) + a
        return F.struct(m.alias("m"), p.alias("p"), (acc.i + 1).alias("i"))

    return F.aggregate(rest, start, step, lambda x: log_sum_exp(x.m, x.p))


def count_motif(seq: Column, motif: str = "CG") -> Column:
    """Occurrences of a motif (a pattern), case and all."""
    return F.regexp_count(seq, F.lit(motif))


def meth_seq(seq: Column, states: Column, plain: str = "CG", marked: str = "MG") -> Column:
    """The sequence with the motif marked where the state is 1; empty if the counts differ."""
    pieces = F.split(seq, plain, -1)
    n = F.size(pieces) - 1
    tails = F.slice(pieces, 2, F.greatest(n, F.lit(0)))
    joined = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(tails, states, lambda p, x: F.concat(F.when(x == 1, marked).otherwise(plain), p)), ""))
    return F.when(n == F.size(states), joined).otherwise("")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
