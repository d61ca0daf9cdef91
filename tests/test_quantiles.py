"""Exact values at ranks against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import evaluation

INF = float("inf")


def between(v: list[float], q: float) -> float:
    r = q * (len(v) - 1)
    a, b = v[math.floor(r)], v[math.ceil(r)]
    return a + (r - math.floor(r)) * (b - a) if r > math.floor(r) else a


def groups() -> dict:
    r = random.Random(8)
    return {
        "even": [r.random() for _ in range(3000)],
        "tails": [r.choice((-1, 1)) * 10 ** r.uniform(-300, 300) for _ in range(1500)],
        "ties": [float(r.randrange(5)) for _ in range(2000)],
        "hot": [7.0] * 1500 + [r.random() * 20 for _ in range(501)],
        "ends": [-INF, INF, -1.7e308, 1.7e308, 5e-324, 0.0, 1.0] * 40,
        "one": [3.5],
        "two": [1.0, 2.0],
        None: [float(i * i) for i in range(701)],
    }


@pytest.mark.parametrize("sorted_at", [1, evaluation.SORTED])
def test_values_at_ranks(spark, sorted_at):
    data = groups()
    rows = spark.createDataFrame([(k, x) for k, v in data.items() for x in v], "k string, v double").repartition(5)
    ranks = F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 3), F.col("n") - 1, F.lit(10**6).cast("long"))
    got = {(x.k, x.r): (x.n, x.x) for x in evaluation.ranked_values(rows, ["k"], F.filter(ranks, lambda r: r < F.col("n")), sorted_at).collect()}
    want = {(k, r): (len(v), sorted(v)[r]) for k, v in data.items() for r in {0, len(v) // 3, len(v) - 1}}
    assert got == want


def test_box_statistics(spark):
    data = {k: v for k, v in groups().items() if k != "ends"}
    rows = [(k, x) for k, v in data.items() for x in v] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in evaluation.box_statistics(df, ["k"], F.col("x")).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        v = sorted(v)
        assert got[k].n == len(v)
        assert [got[k].q1, got[k].median, got[k].q3] == pytest.approx([between(v, q) for q in (0.25, 0.5, 0.75)], rel=1e-12)
    whole = sorted(x for v in data.values() for x in v)
    (all_,) = evaluation.box_statistics(df, [], F.col("x")).collect()
    assert (all_.n, all_.median) == (len(whole), pytest.approx(between(whole, 0.5)))
    assert evaluation.box_statistics(df.limit(0), ["k"], F.col("x")).count() == evaluation.box_statistics(df.limit(0), [], F.col("x")).count() == 0
