"""Simulators, studies, the alignment reader and mates."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import ising
from strandloom.operators import calls, evaluation, simulation
from strandloom.plans import studies
from strandloom.sources import bam


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name: str, flag: int, ref: int, pos: int, mapq: int, xm: str, xs: bool) -> bytes:
    tags = b"NMC\x01" + b"XAZabc\0" + b"BBBc" + struct.pack("<i", 2) + b"\1\2" + b"XMZ" + xm.encode() + b"\0" + (b"XSA+" if xs else b"")
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, 1, flag, 3, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", 3 << 4) + b"\x11\x10" + b"\xff" * 3 + tags
    return struct.pack("<i", len(body)) + body


@pytest.fixture
def bam_file(tmp_path):
    rows = [(f"q{i}", (0, 16)[i % 2], i % 2, 10 + i, 60, "Z..z" * (i % 40 + 1), i % 7 == 0) for i in range(500)]
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 10_000) for n in (b"c1", b"c2"))
    # records cross the blocks' borders
    data, at, offsets, starts = head, len(head), [], []
    for r in rows:
        offsets.append(len(data))
        data += record(*r)
    out, blocks = b"", []
    for i in range(0, len(data), 997):
        blocks.append(len(out))
        out += block(data[i : i + 997])
    out += block(b"")
    path = tmp_path / "a.bam"
    path.write_bytes(out)
    starts = [blocks[o // 997] << 16 | o % 997 for o in offsets]
    return path, rows, starts, at


@pytest.mark.parametrize("indexed", [False, True])
def test_bam(spark, bam_file, indexed):
    path, rows, starts, _ = bam_file
    if indexed:
        picked = starts[::50]
        (path.parent / "a.bam.bai").write_bytes(b"BAI\1" + struct.pack("<i", 2) + struct.pack("<i", 1) + struct.pack("<Ii", 4681, 1) + struct.pack("<QQ", starts[0], starts[9]) + struct.pack("<i", len(picked)) + struct.pack(f"<{len(picked)}Q", *picked) + struct.pack("<ii", 0, 0))
        assert len(bam._splits(str(path), 2000)) > 3
    got = bam.read_bam(spark, str(path), 2000)
    want = [(q, f, f"c{ref + 1}", p, m, xm, xs) for q, f, ref, p, m, xm, xs in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert bam.overlapping(got, "c1", 100, 101).count() == sum(c == "c1" and p <= 101 and p + len(xm) - 1 >= 100 for _, _, c, p, _, xm, _ in want)


def test_damaged_bam_raises(spark, bam_file):
    path = bam_file[0]
    path.write_bytes(path.read_bytes()[:-400])
    with pytest.raises(Exception):  # noqa: B017
        bam.read_bam(spark, str(path)).count()


def stitched(r1, r2, trim):
    """Site states by joining the two strings, as one text from the first mate's start."""
    (p1, x1), (p2, x2) = r1, r2
    a, b = x1[trim[0] : len(x1) - trim[1]], x2[trim[3] : len(x2) - trim[2]]
    far = p2 + trim[3] - p1 - trim[0]
    joined = a + "." * max(0, far - len(a)) + b[max(0, len(a) - far) :]
    return {(p1 + trim[0] + i, c) for i, c in enumerate(joined) if c in "zZ"}


@pytest.mark.parametrize("trim", [(0, 0, 0, 0), (2, 3, 1, 4)])
def test_mates(spark, trim):
    r = random.Random(5)
    pairs = {f"t{i}": ((100, "".join(r.choices("zZ..", k=20))), (100 + r.randint(0, 35), "".join(r.choices("zZ..", k=20)))) for i in range(30)}
    flags = lambda i: ((99, 147), (83, 163), (147, 99), (163, 83))[i % 4]
    rows = [(q, "c", flags(i)[k], 60, p[k][0], p[k][1]) for i, (q, p) in enumerate(pairs.items()) for k in (0, 1)] + [("alone", "c", 99, 60, 5, "zz")]
    df = spark.createDataFrame(rows, "qname string, chr string, flag int, mapq int, pos long, xm string")
    got = {}
    for x in calls.paired_calls(df, trim).collect():
        got.setdefault(x.qname, set()).add((x.pos, "Z" if x.log_m == 0 else "z"))
    for i, (q, (a, b)) in enumerate(pairs.items()):
        want = {(p - (0 if i % 4 in (0, 2) else 1), c) for p, c in stitched(a, b, trim)}
        if b[0] + trim[3] >= a[0] + trim[0] and a[0] != b[0]:
            assert got.get(q, set()) == want
    assert "alone" not in got
    with pytest.raises(Exception, match="unexpected flags"):
        calls.paired_calls(spark.createDataFrame([("t", "c", 99, 60, 1, "z"), ("t", "c", 83, 60, 3, "z")], df.schema)).collect()


def test_metropolis_nears_the_model():
    a, b = [0.4, -0.3, 0.2, 0.1], [0.5, -0.4, 0.3]
    x = ising.metropolis(a, b, 60, 20_000, np.random.default_rng(1))
    assert np.abs(x.mean(0) - ising.summarise(a, b).ex).max() < 0.04


@pytest.mark.parametrize("length,n", [(100, 7), (20, 10), (5, 4), (31, 1)])
def test_spaced_sequence(spark, length, n):
    s = spark.range(3).select(simulation.spaced_sequence(length, n, 1, F.col("id")).alias("s")).collect()
    for r in s:
        assert r.s == "" if length // n < 2 else len(r.s) == length and r.s.count("CG") == n and set(r.s) <= set("ACGT")


def test_reads_states_and_marks(spark):
    r = random.Random(2)
    seq = "".join(r.choices(["CG", "A", "T", "AC", "GT"], k=90_000))
    seqs = spark.createDataFrame([("c1", seq, len(seq)), ("tiny", "ACGT", 4)], "chr string, seq string, length long")
    reads = simulation.simulate_reads(seqs, coverage=3.0, mean=2000.0).cache()
    rows = reads.collect()
    assert all(x.chr == "c1" and x.seq == seq[x.start - 1 : x.end] and x.end - x.start >= 100 for x in rows)
    assert 2 < sum(len(x.seq) for x in rows) / len(seq) < 4
    pos = [i + 1 for i in range(len(seq) - 1) if seq[i : i + 2] == "CG"]
    bounds = [(i, min(i + 2999, len(seq))) for i in range(1, len(seq) + 1, 3000)]
    inside = [[p for p in pos if lo <= p <= hi] for lo, hi in bounds]
    m = spark.createDataFrame([(f"r{i}", "c1", *bounds[i], [30.0] * len(inside[i]), [0.0] * (len(inside[i]) - 1), inside[i]) for i in range(len(bounds))], "region_id string, chr string, chrst long, chrend long, alpha array<double>, beta array<double>, pos array<long>")
    states = simulation.read_states(reads, m)
    assert states.where("x <> 1").count() == 0
    assert states.count() == int(sum(np.searchsorted(pos, x.end, 'right') - np.searchsorted(pos, x.start) for x in rows))
    marked = simulation.marked_reads(reads, states).collect()
    assert len(marked) == len(rows) and all(x.seq == seq[x.start - 1 : x.end].replace("CG", "MG") for x in marked)


def test_augmented_models(spark):
    have = spark.createDataFrame([("c", i * 10, i * 10 + 9, [float(i), 100.0 + i, 200.0 + i]) for i in range(5)], "chr string, chrst long, chrend long, phi array<double>")
    regions = spark.createDataFrame([("c", i * 10, i * 10 + 9, f"r{i}") for i in range(60)], "chr string, chrst long, chrend long, region_id string")
    got = {x.region_id: x for x in simulation.augment_models(have, regions).collect()}
    assert len(got) == 60 and all(got[f"r{i}"].phi == [i, 100 + i, 200 + i] and not got[f"r{i}"].augmented for i in range(5))
    drawn = [got[f"r{i}"].phi for i in range(5, 60)]
    assert all(p[0] in range(5) and p[1] - 100 in range(5) and p[2] - 200 in range(5) for p in drawn) and len({tuple(p) for p in drawn}) > 20
    rep = simulation.replicate_models(have.withColumn("region_id", F.col("chrst").cast("string")), 400)
    z = np.asarray([np.asarray(x.phi) - [x.chrst / 10, 100 + x.chrst / 10, 200 + x.chrst / 10] for x in rep.collect()])
    assert np.abs(z.mean(0)).max() < 0.1 and np.abs(z.std(0) - 1).max() < 0.1


def test_short_reads_come_in_runs(spark):
    m = spark.createDataFrame([("r", [0.2] * 60, [0.3] * 59)], "region_id string, alpha array<double>, beta array<double>")
    seen: dict = {}
    for x in simulation.simulate_short_reads(m, 40, 0.4).collect():
        seen.setdefault(x.read_id, []).append(x.grp)
        assert {x.log_m, x.log_u} == {0.0, -50.0}
    for g in map(sorted, seen.values()):
        cuts = [i for i in range(1, len(g)) if g[i] - g[i - 1] > 1]
        runs = [g[a:b] for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True)]
        assert all(len(r) == 9 for r in runs[:-1]) and len(runs[-1]) <= 9
        assert all(b[0] - a[-1] > 6 for a, b in zip(runs, runs[1:], strict=False))


def test_pvalue_roc(spark):
    r = random.Random(1)
    rows = [(r.random() < 0.5, r.choice([0.0, 0.001, 0.25, 1.0, r.random()])) for _ in range(300)]
    got = evaluation.pvalue_roc(spark.createDataFrame([*rows, (True, None)], "t boolean, p double"), F.col("t"), F.col("p")).collect()
    assert len(got) == 1001
    t, f = [p for x, p in rows if x], [p for x, p in rows if not x]
    for x in got:
        assert x.tpr == pytest.approx(sum(p <= x.threshold for p in t) / (len(t) + 1)) and x.fpr == pytest.approx(sum(p <= x.threshold for p in f) / (len(f) + 1))


@pytest.mark.parametrize("matched", [False, True])
def test_group_study_tells_effect_from_none(spark, matched):
    s = studies.group_study(spark, 4, 5, (-1.5, 0.0, 1.0), (1.5, 0.0, 1.0), config=Config(matched=matched))
    by = {(x.truth, x.test): x.p for x in s.groupBy("truth", "test").agg(F.avg("p").alias("p")).collect()}
    assert by[True, "tmml"] < 0.1 < by[False, "tmml"] and len(by) == 4


def test_group_study_with_fits(spark):
    s = studies.group_study(spark, 1, 2, (-1.5, 0.0, 1.0), (1.5, 0.0, 1.0), reads=8, config=Config(max_em_init=1, max_em_iters=40)).collect()
    assert all(x.p is None for x in s)  # groups of two have no small p


def test_noise_study(spark):
    got = studies.noise_study(spark, [0.3], 4, reads=20, config=Config(max_em_init=2, max_em_iters=60)).collect()
    assert got and all(x.mse >= 0 and x.model in ("noise", "certain") for x in got)
