"""Entry points from calls or alignments to results, against plain loops."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_comparison import plain_values, sequence

from strandloom.config import LOG_RIGHT, LOG_WRONG, Config
from strandloom.functions import ising
from strandloom.operators import models
from strandloom.plans import pipelines
from strandloom.sources import readers

SEQ = sequence(600, 5)[:600]
SITES = [i + 1 for i in range(len(SEQ)) if SEQ[i : i + 2] == "CG"]
RECORD = "qname string, flag int, chr string, pos long, mapq int, xm string, has_xs boolean"


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([("c1", SEQ, len(SEQ))], "chr string, seq string, length long").cache()


def states(reads: int, seed: int) -> list[dict[int, bool]]:
    """Methylation of each read at each site: neighbours agree more often than not."""
    r, out = random.Random(seed), []
    for _ in range(reads):
        now, own = r.random() < 0.6, {}
        for p in SITES:
            now = now if r.random() < 0.5 else r.random() < 0.6
            own[p] = now
        out.append(own)
    return out


def xm(own: dict[int, bool], first: int, last: int, shift: int) -> str:
    return "".join("Zz"[not own[p - shift]] if p - shift in own else "." for p in range(first, last + 1))


def as_records(reads: list, paired: bool) -> list[tuple]:
    out = []
    for i, own in enumerate(reads):
        top = i % 2 == 0
        shift = 0 if top else 1  # the other strand's C is the G after the site
        if paired:
            f1, f2 = (99, 147) if top else (83, 163)
            out += [(f"q{i}", f1, "c1", 1, 60, xm(own, 1, 350, shift), False), (f"q{i}", f2, "c1", 301, 60, xm(own, 301, len(SEQ), shift), False)]
        else:
            out.append((f"q{i}", 0 if top else 16, "c1", 1, 60, xm(own, 1, len(SEQ), shift), False))
    n = len(SEQ)
    # none of these may count: low quality, a secondary hit, unmapped, no calls
    return [*out, ("x0", 0, "c1", 1, 39, "Z" * n, False), ("x1", 0, "c1", 1, 60, "Z" * n, True), ("x2", 4, "c1", 1, 60, "Z" * n, False), ("x3", 0, "c1", 1, 60, None, False)]


@pytest.mark.parametrize("paired", [False, True])
def test_bisulfite_from_alignments_to_tables(spark, seqs, tmp_path, paired):
    reads = states(24, 7)
    config = Config(min_grp_dist=1, max_em_init=2, max_em_iters=80, pe=paired)
    if paired:  # a template with one mate isn't used
        more = [("x4", 99, "c1", 1, 60, "Z" * 50, False)]
    else:
        more = []
    got = pipelines.analyze_bisulfite(spark, spark.createDataFrame([*as_records(reads, paired), *more], RECORD), seqs, config, out=str(tmp_path / "x"))
    fits = got["models"].collect()
    assert len(fits) == 1
    (fit,) = fits
    pos = [p for p in SITES if fit.chrst <= p <= fit.chrend]
    assert pos == SITES
    m = np.asarray([[LOG_RIGHT if own[p] else LOG_WRONG for p in pos] for own in reads])
    u = np.asarray([[LOG_WRONG if own[p] else LOG_RIGHT for p in pos] for own in reads])
    c0, c1 = max(1, fit.chrst - 500), min(len(SEQ), fit.chrend + 500)
    rho = np.asarray([sum(p - 501 <= x <= p + 498 for x in SITES if c0 <= x and x + 1 <= c1) / 1000 for p in pos])
    d = np.append(np.diff(pos), 0).astype(float)
    want = ising.fit_em(u, m, np.ones(len(pos)), rho, d, config.max_em_init, config.max_em_iters, zlib.crc32(f"{(fit.region_id,)}{config.seed}".encode()))
    assert want.converged and list(fit.phi) == pytest.approx(list(want.phi), abs=1e-3)
    plain = plain_values({(0, 0): np.asarray(fit.phi)}, SEQ, ((fit.chrst, fit.chrend),))
    values = {(r.start, r.end): r for r in got["analysis"].where("mml is not null").collect()}
    assert set(values) == set(plain)
    for k, by in plain.items():
        assert (values[k].mml, values[k].nme) == pytest.approx(by[0][:2])
    # what was written: the fit, at the scale of sites
    back = readers.read_models(spark, str(tmp_path / "x_theta")).first()
    assert list(back.phi) == pytest.approx(list(fit.phi), abs=1e-4) and len(back.alpha) == len(pos)


def single_calls(spark, reads: list, prefix: str = "r"):
    rows = [("c1", p - 1, p - 1, f"{prefix}{i}", LOG_RIGHT if m else LOG_WRONG, LOG_WRONG if m else LOG_RIGHT) for i, own in enumerate(reads) for p, m in own.items()]
    return spark.createDataFrame(rows, "chr string, start long, end long, read_id string, log_m double, log_u double").cache()


def test_targets(spark):
    """Targets are cut alone: regions cover them and nothing else, and averages are those of the whole."""
    seq = sequence(6000, 9)[:6000]
    sites, r = [i + 1 for i in range(len(seq)) if seq[i : i + 2] == "CG"], random.Random(3)
    seqs = spark.createDataFrame([("c1", seq, len(seq))], "chr string, seq string, length long").cache()
    calls, config = single_calls(spark, [{p: r.random() < 0.6 for p in sites} for _ in range(12)]), Config(min_grp_dist=1, size_est_reg=1200)
    targets = spark.createDataFrame([("c1", 400, 3300), ("c1", 3600, 5500), ("c9", 1, 50)], "chr string, start long, end long")
    regions = sorted((r.chrst, r.chrend) for r in pipelines.genome_tables(seqs, config, targets)["regions"].where("chr = 'c1'").collect())
    runs: list[list[int]] = []
    for a, b in regions:
        if runs and runs[-1][1] + 1 == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    assert runs == [[400, 3300], [3600, 5500]] and len(regions) > 2
    some = {r.pos: r.ex for r in pipelines.nano_smp_est(calls, seqs, config, targets).collect()}
    whole = {r.pos: r.ex for r in pipelines.nano_smp_est(calls, seqs, config).collect()}
    assert set(some) == {p for p in sites if 400 <= p <= 3300 or 3600 <= p <= 5500} and set(whole) == set(sites)
    assert all(v == pytest.approx(whole[p]) for p, v in some.items())


def test_calls_by_the_name_of_the_caller(spark, tmp_path):
    lines = ["chromosome\tstrand\tstart\tend\tread_name\tratio\tlm\tlu\tn", *(f"c1\t+\t{i}\t{i + 4}\tr{i % 3}\t{-1.5}\t{-2.0 - i}\t{-0.5}\t1" for i in range(9))]
    (tmp_path / "calls.tsv").write_text("\n".join(lines) + "\n")
    got = sorted((r.chr, r.start, r.end, r.read_id, r.log_m, r.log_u) for r in pipelines.read_calls_of(spark, str(tmp_path / "calls.tsv"), Config()).collect())
    assert got == [("c1", i, i + 4, f"r{i % 3}", -2.0 - i, -0.5) for i in range(9)]
    with pytest.raises(ValueError, match="unknown caller: other"):
        pipelines.read_calls_of(spark, str(tmp_path / "calls.tsv"), Config(caller="other"))


def test_two_samples_at_sites(spark):
    """Calls of single sites: with ``at_sites`` every site is a unit, whatever its neighbours' distance."""
    seq = sequence(170, 11)[:170]
    seqs = spark.createDataFrame([("c1", seq, len(seq))], "chr string, seq string, length long").cache()
    tables = pipelines.genome_tables(seqs, Config())
    sites = [i + 1 for i in range(len(seq)) if seq[i : i + 2] == "CG"]
    assert tables["groups"].count() < len(sites)  # groups of several sites, which such calls don't match
    none, sides, r = F.lit(None).cast("array<double>"), [], random.Random(2)
    for side, a in ((0, -1.5), (1, 1.5)):
        share = 0.1 if side == 0 else 0.9
        reads = [{p: r.random() < share for p in sites} for _ in range(6)]
        sides.append((single_calls(spark, reads), tables["regions"].withColumns({"phi": F.array(F.lit(a), F.lit(5.0), F.lit(3.0)), "alpha": none, "beta": none}).cache()))
    config = Config(lmax_two_samp=24, max_em_init=1, max_em_iters=60)
    (calls1, model1), (calls2, model2) = sides
    got = {(x.test, x.start, x.end): x for x in pipelines.diff_two_samp_comp(spark, model1, model2, calls1, calls2, seqs, config, at_sites=True).collect()}
    (region,) = tables["regions"].collect()
    phi = {(s, 0): np.asarray([a, 5.0, 3.0]) for s, a in ((0, -1.5), (1, 1.5))}
    plain = plain_values(phi, seq, ((region.chrst, region.chrend),))
    assert {k[1:] for k in got} == set(plain) and len(got) == 3 * len(plain)
    for k, by in plain.items():
        (m0, n0, s0, p, q), (m1, n1, s1, *_) = by[0], by[1]
        assert got["tmml", *k].stat == pytest.approx(abs(m0 - m1)) and got["tnme", *k].stat == pytest.approx(abs(n0 - n1))
        assert got["tcmd", *k].stat == pytest.approx(ising.cmd(s0, s1, ising.mixture(s0, s1), p, q))
        assert got["tmml", *k].p is not None and got["tmml", *k].p <= 0.2
