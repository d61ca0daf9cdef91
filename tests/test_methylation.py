"""Kernels against enumeration, readers and writers by round trip, pipelines on simulated reads."""

from __future__ import annotations

import random
from itertools import product
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import ising, scalars
from strandloom.operators import calls, comparison, genome, models
from strandloom.plans import pipelines
from strandloom.sources import readers, writers


def brute(alpha, beta):
    x = np.asarray(list(product((-1, 1), repeat=len(alpha))), float)
    u = x @ np.asarray(alpha) + (x[:, 1:] * x[:, :-1]) @ np.asarray(beta)
    z = np.exp(u).sum()
    return x, np.exp(u) / z, log(z)


@pytest.mark.parametrize("n", [2, 3, 7])
def test_kernels_by_enumeration(n):
    r = np.random.default_rng(n)
    a, b = r.normal(0, 1, n), r.normal(0, 1, n - 1)
    x, p, z = brute(a, b)
    s = ising.summarise(a, b)
    assert s.log_z == pytest.approx(z)
    assert s.ex == pytest.approx(p @ x)
    assert s.exx == pytest.approx(p @ (x[:, 1:] * x[:, :-1]))
    lo, hi = n // 3, n - 1
    part = {}
    for row, q in zip(x, p, strict=True):
        part[tuple(row[lo : hi + 1])] = part.get(tuple(row[lo : hi + 1]), 0) + q
    h = -sum(q * np.log2(q) for q in part.values()) / (hi - lo + 1)
    assert ising.nme(s, lo, hi) == pytest.approx(h)
    assert ising.mml(s, lo, hi) == pytest.approx((1 + (p @ x)[lo : hi + 1].mean()) / 2)


def test_known_values():
    s = ising.summarise(np.zeros(10), np.zeros(9))
    assert s.log_z == pytest.approx(log(1024)) and np.abs(s.ex).max() < 1e-12 and np.abs(s.exx).max() < 1e-12
    z = ising.expectations(ising.fields(np.zeros(10)) - 100, np.zeros(9))[0]
    assert float(z) == pytest.approx(-993.0685281944009)


def test_divergence_of_equal_models_is_zero():
    s = ising.summarise([0.3, -0.2, 0.1], [0.5, 0.1])
    assert ising.cmd(s, s, ising.mixture(s, s), 0, 2) == pytest.approx(0)


def test_sampler_has_the_models_means():
    a, b = [0.4, -0.3, 0.2, 0.1], [0.5, -0.4, 0.3]
    x = ising.sample(a, b, 40_000, np.random.default_rng(1))
    assert np.abs(x.mean(0) - ising.summarise(a, b).ex).max() < 0.03


def test_fit_recovers():
    rng = np.random.default_rng(3)
    n, rho, d = np.ones(30), rng.uniform(0.01, 0.05, 30), np.append(rng.integers(10, 60, 29), 0)
    truth = np.asarray([-0.5, 30.0, 5.0])
    a, b = ising.link(truth, n, rho, d)
    u, m = ising.emissions(ising.sample(a, b, 80, rng), rng)
    f = ising.fit_em(u, m, n, rho, d, starts=4, iters=60, seed=5)
    assert f.converged

    def mean_log_lik(phi):
        a, b = ising.link(phi, n, rho, d)
        e = np.stack([u, m], -1)
        return float((ising.expectations(ising.fields(a) + e, b)[0] - ising.expectations(ising.fields(a), b)[0]).mean())

    assert f.q == pytest.approx(mean_log_lik(f.phi)) and f.q >= mean_log_lik(truth) - 1e-3


def test_log_z_in_sql(spark):
    a, b = [0.3, -0.7, 1.1, 0.2], [0.4, -0.6, 0.9]
    df = spark.createDataFrame([(a, b), ([0.5], [])], "a array<double>, b array<double>").select(scalars.ising_log_z(F.col("a"), F.col("b")).alias("z"))
    assert sorted(r.z for r in df.collect()) == pytest.approx(sorted([brute(a, b)[2], brute([0.5], [])[2]]))


@pytest.mark.parametrize("pos,dist,want", [([10], 10, [(10, 10, 1)]), ([10, 25, 28, 50], 10, [(5, 15, 1), (20, 33, 2), (45, 55, 1)]), ([10, 18, 26, 50, 58, 66], 10, [(5, 31, 3), (45, 71, 3)])])
def test_groups(spark, pos, dist, want):
    df = spark.createDataFrame([("c", p) for p in pos], "chr string, pos long")
    assert [(r.grp_start, r.grp_end, r.n_cpg) for r in genome.gap_groups(df, "chr", dist).orderBy("grp").collect()] == want


def test_balanced_pieces(spark):
    df = spark.createDataFrame([("r", 1, 1007)], "region_id string, st long, en long")
    got = genome.balanced_split(df, "region_id", "st", "en", 121).orderBy("k").collect()
    assert len(got) == 9 and got[0].sub_start == 1 and got[-1].sub_end == 1007
    assert [r.sub_end - (0 if r.k == 1 else r.sub_start) for r in got] == [112] * 8 + [111]


def sequence(n: int, seed: int = 1) -> str:
    r = random.Random(seed)
    return "".join(r.choice(("CG", "A", "T", "G", "C", "AT")) if r.random() < 0.5 else r.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def seqs(spark):
    s = sequence(2200)
    return spark.createDataFrame([("c1", s, len(s))], "chr string, seq string, length long").cache()


def test_density(spark, seqs):
    s = seqs.first().seq
    cg = [i + 1 for i in range(len(s)) if s[i : i + 2] == "CG"]
    sites = genome.motif_positions(seqs, "chr", "seq").select("chr", "pos")
    assert sorted(r.pos for r in sites.collect()) == cg
    regions = spark.createDataFrame([("r", "c1", 1, 2000), ("s", "c1", 2001, 5000)], "region_id string, chr string, chrst long, chrend long")
    for r in genome.region_density(sites, regions, F.lit(len(s))).collect():
        c0, c1 = max(1, r.chrst - 500), min(len(s), r.chrend + 500)
        off, n = r.pos - c0, c1 - c0 + 1
        lo, hi = c0 + max(1, off - 500) - 1, c0 + min(n, off + 500) - 1
        assert r.rho == pytest.approx(sum(x >= lo and x + 1 <= hi for x in cg) / 1000)


def test_partition_cuts_no_group(spark, seqs):
    sites = genome.motif_positions(seqs, "chr", "seq").select("chr", "pos")
    n = seqs.first().length
    parts = sorted((r.chrst, r.chrend) for r in genome.chromosome_partition(sites, seqs.select("chr", F.lit(1).alias("first"), F.col("length").alias("last"))).collect())
    assert parts[0][0] == 1 and parts[-1][1] == n and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one two\nACGT\nAC\n>b\nGG\n")
    assert sorted((r.chr, r.seq, r.length) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("b", "GG", 2), ("one", "ACGTAC", 6)]
    (tmp_path / "a.bed").write_text("c\t5\t9\nc\t9\t5\n")
    assert readers.read_bed(spark, str(tmp_path / "a.bed")).count() == 1
    (tmp_path / "m.txt").write_text("c\t1\t9\t1.0,2.5,NaN\nc\t10\t19\t1,2,3\t0.1,0.2\t0.5\n")
    m = readers.read_models(spark, str(tmp_path / "m.txt")).orderBy("chrst").collect()
    assert m[0].phi == [1.0, 2.5, None] and m[0].alpha is None and m[1].beta == [0.5] and m[1].region_id == "c_10_19"
    (tmp_path / "p.tsv").write_text("kmer\tm\ts\nACG\t1.0\t2.0\nAMG\t3.0\t4.0\nTMG\t5.0\t6.0\nAAA\t1\t1\n")
    assert {(r.kmer, r.mean_u, r.mean_m) for r in readers.read_pore_model(spark, str(tmp_path / "p.tsv")).collect()} == {("ACG", 1.0, 3.0), ("TCG", None, 5.0)}
    (tmp_path / "r.fq").write_text("@a x\nACGT\n+\n@!!!\n@b\nAC\n+\n!!\n")
    assert sorted((r.read_id, r.length) for r in readers.read_fastq_lengths(spark, str(tmp_path / "r.fq")).collect()) == [("a", 4), ("b", 2)]
    (tmp_path / "r.sam").write_text("@HD\tVN:1\n" + "\n".join(f"q{i}\t{f}\tc\t{p}\t{mq}\t*\t*\t0\t0\t*\t*\tXM:Z:{xm}{xs}" for i, (f, p, mq, xm, xs) in enumerate([(0, 11, 60, "Z..z", ""), (16, 11, 60, ".Z", ""), (0, 1, 39, "Z", ""), (4, 1, 60, "Z", ""), (0, 1, 60, "Z", "\tXS:i:1")])) + "\n")
    got = calls.bisulfite_calls(calls.usable_alignments(readers.read_sam(spark, str(tmp_path / "r.sam")))).collect()
    assert {(r.qname, r.pos, r.log_m) for r in got} == {("q0", 11, 0.0), ("q0", 14, -50.0), ("q1", 11, 0.0)}


@pytest.fixture(scope="module")
def reads(spark, seqs):
    """Calls of simulated reads over all regions of the sequence."""
    tables = pipelines.genome_tables(seqs, Config())
    phi = tables["by_group"].withColumn("phi", F.array(F.lit(-0.5), F.lit(20.0), F.lit(5.0)))
    sim = models.simulate_calls(models.alphas(phi), 25, seed=4)
    g = tables["groups"].join(tables["regions"], "region_id")
    return sim.join(g, ["region_id", "grp"]).select("chr", (F.col("first_pos") - 1).alias("start"), (F.col("last_pos") - 1).alias("end"), "read_id", "log_m", "log_u").cache()


def test_analyze_nano(spark, seqs, reads, tmp_path):
    got = pipelines.analyze_nano(spark, reads, seqs, Config(max_em_init=1, max_em_iters=70), out=str(tmp_path / "x"))
    assert got["models"].count() >= 1
    for r in got["analysis"].where("mml is not null").collect():
        assert 0 <= r.mml <= 1 and -1e-9 <= r.nme <= 1 + 1e-9
    for k in ("theta", "ex", "exx", "mml", "nme"):
        assert spark.read.csv(str(tmp_path / f"x_{k}"), sep="\t").count() > 0
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_ex(got["sites"], str(tmp_path / "x_ex"))


def test_sample_averages(spark, seqs, reads):
    got = pipelines.nano_smp_est(reads, seqs).where("ex is not null").collect()
    assert got and all(-1 <= r.ex <= 1 and (r.exx is None or -1 <= r.exx <= 1) for r in got)


def test_two_samples(spark, seqs):
    regions = pipelines.genome_tables(seqs, Config())["regions"]
    none = F.lit(None).cast("array<double>")
    fit = regions.withColumns({"phi": F.array(F.lit(-0.5), F.lit(20.0), F.lit(5.0)), "alpha": none, "beta": none}).cache()
    d = pipelines.diff_two_samp_comp(spark, fit, fit, None, None, seqs)
    rows = d.collect()
    assert {r.test for r in rows} == {"tmml", "tnme", "tcmd"} and all(abs(r.stat) < 1e-9 and r.p is None for r in rows)


def test_false_discovery(spark):
    p = [0.01, 0.02, 0.02, 0.5, None, 0.9]
    got = {r.i: r.q for r in comparison.bh(spark.createDataFrame(list(enumerate(p)), "i int, p double").withColumn("t", F.lit("a")), ["t"]).collect()}
    assert got[4] is None and [got[i] for i in (0, 1, 2, 3, 5)] == pytest.approx([1 / 30, 1 / 30, 1 / 30, 0.625, 0.9])


def test_small_groups_have_no_p(spark):
    v = spark.createDataFrame([("a", 1 + (i >= 3), i, float(i)) for i in range(6)], "k string, grp int, i int, x double")
    r = comparison.unmatched_test(v, ["k"]).first()
    assert r.stat == -3 and r.p is None
    m = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "k string, i int, x double")
    assert comparison.matched_test(m, ["k"]).first().p is None
    five = spark.createDataFrame([("a", i, 1.0) for i in range(5)], "k string, i int, x double")
    assert comparison.matched_test(five, ["k"]).first().p == pytest.approx(2 / 32)


def test_unexpected_flag_raises(spark):
    with pytest.raises(Exception, match="unexpected flag"):
        spark.range(1).select(scalars.strand(F.lit(False), F.lit(99))).collect()
