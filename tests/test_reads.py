"""Read likelihoods of many reads at once against a read at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import ising
from strandloom.operators import models


def _reads(r: np.random.Generator, n: int):
    """Models of several lengths and reads with missing, repeated and unobserved calls."""
    alphas, betas, calls = [], [], []
    for _ in range(n):
        k = int(r.integers(1, 9))
        alphas.append(r.normal(size=k))
        betas.append(r.normal(size=k - 1))
        calls.append([(int(r.integers(k)), float(r.normal() if r.random() < 0.9 else np.nan), float(r.normal())) for _ in range(r.integers(0, 2 * k))])
    return alphas, betas, calls


def _plain(alpha, beta, calls) -> tuple[float, float]:
    u = np.full((1, len(alpha)), np.nan)
    m = u.copy()
    for g, x, y in calls:
        u[0, g], m[0, g] = x, y
    return ising.read_log_likelihoods(alpha, beta, u, m)[0], ising.expected_log_emissions(alpha, beta, u, m)[0]


def _flat(lists):
    return np.concatenate([np.asarray(x, float) for x in lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def test_reads_at_once_equal_one_at_a_time():
    r = np.random.default_rng(5)
    alphas, betas, calls = _reads(r, 300)
    for i in range(0, 300, 3):  # neighbours of one model
        alphas[i + 1], betas[i + 1] = alphas[i], betas[i]
        calls[i + 1] = [c for c in calls[i + 1] if c[0] < len(alphas[i])]
    want = np.asarray([_plain(*x) for x in zip(alphas, betas, calls, strict=True)])
    site, offsets = _flat([[c[0] for c in x] for x in calls])
    u, m = (_flat([[c[k] for c in x] for x in calls])[0] for k in (1, 2))
    for cells in (1, 40, 1 << 17):
        got = ising.read_statistics(_flat(alphas), _flat(betas), (site.astype(int), offsets), u, m, cells)
        assert np.allclose(np.stack(got, axis=1), want, atol=1e-10)


def test_reads_of_a_batch_share_the_kernel(spark, monkeypatch):
    """The kernel runs once a batch, not once a read: what made its time grow to hours."""
    seen = []
    real = ising.read_statistics
    monkeypatch.setattr(ising, "read_statistics", lambda *a: seen.append(len(a[0][1]) - 1) or real(*a))

    calls = spark.range(4000).select(F.lit("r").alias("region_id"), (F.col("id") % 1000).cast("string").alias("read_id"), (F.floor(F.col("id") / 1000) + 1).cast("int").alias("grp"), (F.col("id") % 7 / 7).alias("log_m"), (F.col("id") % 5 / 5).alias("log_u"))
    model = spark.createDataFrame([("r", [0.1, -0.2, 0.3, 0.4], [0.5, 0.5, 0.5])], "region_id string, alpha array<double>, beta array<double>")
    frame = type(calls)
    monkeypatch.setattr(frame, "mapInArrow", lambda df, run, schema: list(run(df.toArrow().combine_chunks().to_batches())))
    made = models.read_likelihoods(calls, model)
    assert seen == [1000]
    got = {i: (x, y) for b in made for i, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)}
    for k in (0, 1, 137, 999):
        want = _plain([0.1, -0.2, 0.3, 0.4], [0.5] * 3, [(g, (k + 1000 * g) % 5 / 5, (k + 1000 * g) % 7 / 7) for g in range(4)])
        assert np.allclose(got[str(k)], want)
