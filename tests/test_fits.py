"""EM with the reads of a region spread over tasks against one group a region, and at its end."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import ising
from strandloom.operators import models
from strandloom.session import ship


@pytest.fixture(scope="module")
def regions(spark):
    ship(spark)
    r = np.random.default_rng(3)
    rows = [(f"r{i}", r.integers(1, 4, 8).astype(float).tolist(), r.uniform(0.01, 0.1, 8).tolist(), [*r.integers(11, 60, 7).astype(float).tolist(), 0.0], [float(x) for x in (r.uniform(-1, 1), r.uniform(-5, 5), r.uniform(1, 6))]) for i in range(4)]
    profile = spark.createDataFrame(rows, "region_id string, n array<double>, rho array<double>, d array<double>, phi array<double>").cache()
    calls = models.simulate_calls(models.alphas(profile), 60, sd=1.5, observed=0.8, seed=5).cache()
    reads = calls.select("region_id", "read_id").distinct().unionByName(spark.createDataFrame([("r0", "silent")], "region_id string, read_id string")).cache()
    return profile, calls, reads


def test_reads_spread_over_tasks_give_the_same_fit(spark, regions):
    profile, calls, reads = regions
    want = {r.region_id: r for r in models.fit_regions(calls, profile, reads, starts=4, iters=40).collect()}
    got = {r.region_id: r for r in models.fit_regions_by_reads(calls.repartition(5), profile, reads, starts=4, iters=40).collect()}
    assert set(got) == set(want) and any(r.converged for r in want.values())
    for k, r in want.items():
        assert got[k].converged == r.converged
        if r.converged:
            assert got[k].phi == pytest.approx(r.phi, abs=0.05) and got[k].log_lik == pytest.approx(r.log_lik, abs=1e-3)


def test_the_fit_is_a_stationary_point(spark, regions):
    """Posterior statistics of the reads equal the model's at phi, which is where the likelihood's gradient is 0."""
    profile, calls, reads = regions
    fits = {r.region_id: r for r in models.fit_regions_by_reads(calls, profile, reads, starts=4, iters=60).where("converged").collect()}
    by = {r.region_id: r for r in profile.collect()}
    assert fits
    for k, f in fits.items():
        names = sorted({r.read_id for r in reads.where(F.col("region_id") == k).collect()})
        u = np.full((len(names), 8), np.nan)
        m = u.copy()
        for c in calls.where(F.col("region_id") == k).collect():
            u[names.index(c.read_id), c.grp - 1], m[names.index(c.read_id), c.grp - 1] = c.log_u, c.log_m
        t = ising.Terms(by[k].n, by[k].rho, by[k].d)
        phi, e = np.asarray([f.phi]), ising.evidence_of(u, m)
        gap = t.expected(phi, e).mean(axis=1) - t.moments(phi)
        like = lambda p: t.log_likelihoods(np.asarray([p]), e).mean()
        slope = [(like(phi[0] + h) - like(phi[0] - h)) / 2e-4 for h in 1e-4 * np.eye(3)]
        assert gap[0] == pytest.approx(slope, abs=1e-4)  # the gradient is that gap
        assert (np.abs(ising._free(phi, -gap, np.asarray(ising.BOX))) <= 0.02 * t.reach).all()


def test_chains_of_a_batch_are_those_alone():
    """Padded together, chains of any lengths give what each gives alone; a chain over the room is alone."""
    r = np.random.default_rng(8)
    sizes = [1, 2, 2, 7, 40, 3, 40, 300, 1, 12]
    alphas, betas = [r.normal(0, 2, n) for n in sizes], [r.normal(0, 2, n - 1) for n in sizes]
    alphas[3][2], betas[4][5] = np.nan, 400.0  # a gap spoils its own chain only
    for cells in (1, 50, 1 << 17):
        for a, b, got in zip(alphas, betas, ising.summarise_all(alphas, betas, cells), strict=True):
            want = ising.summarise(a, b)
            for k in ("ex", "exx", "p", "f", "b"):
                assert getattr(got, k).shape == getattr(want, k).shape
                np.testing.assert_allclose(getattr(got, k), getattr(want, k), atol=1e-9)
            np.testing.assert_allclose(got.log_z, want.log_z)
    assert ising.summarise_all([], []) == []
