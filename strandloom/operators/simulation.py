"""Simulators of sequences, reads, states and models.

Every draw is a hash of its key and a seed: a retried task draws the same again, and no draw
depends on how rows are partitioned.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import ising
from strandloom.functions.scalars import meth_seq
from strandloom.operators.genome import overlap_join

#: Mean of the read lengths, fixed by published runs.
MEAN_READ = 8484.84
#: Bases a tile: reads are cut from tiles, never from a whole chromosome in a row.
TILE = 1 << 16


def uniform(seed: int, *keys: Column) -> Column:
    """A double in (0, 1) from the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, F.lit("r"), *keys))) * F.cos(2 * math.pi * uniform(seed, F.lit("t"), *keys))


def grid_uniform(low: float, high: float, step: float, seed: int, *keys: Column) -> Column:
    """A value of low, low + step, ..., high."""
    n = round((high - low) / step) + 1
    return low + step * F.floor(uniform(seed, *keys) * n)


def read_length(seed: int, *keys: Column, mean: float = MEAN_READ) -> Column:
    """An exponential length, rounded."""
    return F.round(-mean * F.log(uniform(seed, *keys))).cast("long")


def spaced_sequence(length: int, n: int, seed: int, *keys: Column) -> Column:
    """Random bases whose only CG are ``n`` evenly spaced ones; empty if they don't fit."""
    step = length // n if n else 0
    if step < 2:
        return F.lit("")
    base = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit("ACGT"), (F.floor(uniform(seed, i, *keys) * 4) + 1).cast("int"), 1))
    first = max(step // 2, 1)
    place = lambda i: F.pmod(i - first, F.lit(step))
    # no random CG is left, then C and G are set at every step
    plain = F.split(F.regexp_replace(F.array_join(base, ""), "CG", "CA"), "")
    at = lambda j: F.when((j >= first) & (j < first + n * step), place(j))
    return F.array_join(F.transform(plain, lambda b, j: F.when(at(j + 1) == 0, "C").when(at(j + 1) == 1, "G").otherwise(b)), "")


def simulate_reads(sequences: DataFrame, coverage: float = 25.0, mean: float = MEAN_READ, min_len: int = 100, max_unknown: float = 0.05, seed: int = 17) -> DataFrame:
    """read_id, chr, start, end (1-based, inclusive), seq: reads over ``sequences`` (chr, seq, length).

    As many as give the coverage of the known bases on average; a length of at most ``min_len`` is
    drawn anew (the exponential has no memory: the draw is shifted), a read longer than its
    chromosome or with too many N goes.
    """
    known = F.col("length") - F.regexp_count("seq", F.lit("[Nn]"))
    count = F.ceil(coverage * known / (mean + min_len)).cast("long")
    sized = sequences.select("chr", "length", count.alias("n")).where("n > 0")
    each = sized.select("chr", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    each = each.withColumn("len", min_len + 1 + read_length(seed, F.col("chr"), F.col("i"), mean=mean)).where("len <= length")
    start = (1 + F.floor(uniform(seed + 1, F.col("chr"), F.col("i")) * (F.col("length") - F.col("len") + 1))).cast("long")
    reads = each.select(F.concat_ws(":", "chr", "i").alias("read_id"), "chr", start.alias("start"), (start + F.col("len") - 1).alias("end"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / TILE)), lambda t: F.struct(t.alias("tile"), F.col("seq").substr((t * TILE + 1).cast("int"), F.lit(TILE)).alias("bases")))
    tiles = sequences.where("length > 0").select("chr", F.explode(cut).alias("t")).select("chr", "t.tile", "t.bases")
    near = reads.withColumn("tile", F.explode(F.sequence(F.floor((F.col("start") - 1) / TILE), F.floor((F.col("end") - 1) / TILE))))
    a = F.greatest(F.col("start") - F.col("tile") * TILE, F.lit(1))
    b = F.least(F.col("end") - F.col("tile") * TILE, F.lit(TILE))
    piece = F.struct("tile", F.col("bases").substr(a.cast("int"), (b - a + 1).cast("int")).alias("s"))
    whole = near.join(tiles, ["chr", "tile"]).groupBy("read_id", "chr", "start", "end").agg(F.sort_array(F.collect_list(piece)).alias("v"))
    out = whole.withColumn("seq", F.array_join(F.transform("v", lambda x: x.s), "")).drop("v")
    return out.where(F.regexp_count("seq", F.lit("[Nn]")) < max_unknown * F.length("seq"))


def read_states(reads: DataFrame, models: DataFrame, seed: int = 17) -> DataFrame:
    """read_id, chr, pos, x (-1 or 1): an exact draw of each region that a read spans.

    ``models``: region_id, chr, chrst, chrend, alpha, beta, pos (arrays over sites). A region of one
    site is methylated. A region is drawn whole and cut to the read.
    """
    pairs = overlap_join(reads.select("read_id", "chr", "start", "end"), models, "chr", "start", "end", "chrst", "chrend", 4096)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                pos = np.asarray(r.pos, np.int64)
                rng = np.random.default_rng(zlib.crc32(f"{r.read_id}|{r.region_id}|{seed}".encode()))
                x = np.ones(1, np.int8) if len(pos) == 1 else ising.sample(r.alpha, np.asarray(r.beta, float), 1, rng)[0]
                kept = (pos >= r.start) & (pos <= r.end)
                yield pd.DataFrame({"read_id": r.read_id, "chr": r.chr, "pos": pos[kept], "x": x[kept].astype(np.int32)})

    cols = pairs.where(F.size("pos") > 0).select("read_id", "chr", "start", "end", "region_id", "alpha", "beta", "pos")
    return cols.mapInPandas(run, "read_id string, chr string, pos long, x int")


def marked_reads(reads: DataFrame, states: DataFrame) -> DataFrame:
    """The reads with M for the C of their methylated sites; reads without a site go."""
    inside = states.join(reads.select("read_id", "end"), "read_id").where("pos < end")  # a C at the last base is no site of the read
    v = inside.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    marked = reads.join(v, "read_id").withColumn("seq", meth_seq(F.upper("seq"), F.transform("v", lambda s: s.x)))
    return marked.where("seq <> ''").drop("v")


def augment_models(models: DataFrame, regions: DataFrame, seed: int = 17) -> DataFrame:
    """chr, chrst, chrend, region_id, phi, augmented: each region's own phi, else one of donors.

    Each of the three parameters comes from a donor of its own, drawn uniformly from ``models``.
    """
    keys = ["chr", "chrst", "chrend"]
    # donors get gapless numbers by counts of hash buckets, not by one sort of all
    own = models.where("phi is not null").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(1024)))
    sizes = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # at most 1024 rows
    base = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"))
    inner = W.partitionBy("bucket").orderBy(*keys, "phi")
    donors = own.withColumn("at", F.row_number().over(inner) - 1).join(base, "bucket").select((F.col("at") + F.col("before")).alias("donor"), F.col("phi").alias("given"))
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    wanted = regions.select(*keys, "region_id").join(models.select(*keys, "phi"), keys, "left")
    lacking = wanted.where("phi is null").crossJoin(F.broadcast(total))
    draws = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(uniform(seed, F.col("region_id"), F.lit(j)) * F.col("total")).alias("donor")) for j in range(3)]))
    three = lacking.select(*keys, "region_id", draws.alias("d")).select(*keys, "region_id", "d.j", "d.donor").join(donors, "donor")
    filled = three.groupBy(*keys, "region_id").agg(F.sort_array(F.collect_list(F.struct("j", F.get("given", F.col("j")).alias("v")))).alias("v"))
    return wanted.where("phi is not null").withColumn("augmented", F.lit(False)).unionByName(filled.select(*keys, "region_id", F.transform("v", lambda x: x.v).alias("phi"), F.lit(True).alias("augmented")))


def replicate_models(models: DataFrame, replicates: int, sd: float = 1.0, seed: int = 17) -> DataFrame:
    """Each model ``replicates`` times (column ``rep`` from 1) with Gaussian noise on phi."""
    each = models.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return each.withColumn("phi", F.transform("phi", lambda v, j: v + sd * normal(seed, F.col("region_id"), F.col("rep"), j)))


def group_models(spark: SparkSession, keys: DataFrame, n1: int, n2: int, noise: float = 1.0, step: int = 25, length: int = 3000, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(models, sites) of two groups of replicates for each row of ``keys`` (region_id, phi1, phi2).

    Sites lie every ``step`` bases; densities are drawn once a region and shared. Each replicate's
    phi is its group's plus ``noise`` times a draw from fixed grids.
    """
    place = F.explode(F.sequence(F.lit(step).cast("long"), F.lit(length - step).cast("long"), F.lit(step).cast("long")))
    sites = keys.select("region_id", place.alias("pos")).withColumn("rho", grid_uniform(0.001, 0.1, 0.001, seed, F.col("region_id"), F.col("pos")))
    v = sites.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rho"))).alias("v"))
    profile = v.select("region_id", F.transform("v", lambda x: F.lit(1.0)).alias("n"), F.transform("v", lambda x: x.rho).alias("rho"), F.transform("v", lambda x, i: F.when(i < F.size("v") - 1, float(step)).otherwise(0.0)).alias("d"))
    each = keys.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n1 + n2 - 1)))).withColumn("grp", F.when(F.col("sample") < n1, 1).otherwise(2))
    mine = F.when(F.col("grp") == 1, F.col("phi1")).otherwise(F.col("phi2"))
    grids = ((-0.1, 0.1, 0.01), (-0.5, 0.5, 0.01), (0.0, 0.2, 0.01))
    phi = F.array(*[mine[j] + noise * grid_uniform(*g, seed + 1, F.col("region_id"), F.col("sample"), F.lit(j)) for j, g in enumerate(grids)])
    models = each.select("region_id", "sample", "grp", phi.alias("phi")).join(profile, "region_id")
    info = {"chr": F.lit("sim"), "chrst": F.lit(1).cast("long"), "chrend": F.lit(length).cast("long")}
    return models.withColumns(info), sites.withColumns(info)


def simulate_short_reads(models: DataFrame, reads: int, start: float = 0.5, run: int = 9, gap: int = 6, seed: int = 17) -> DataFrame:
    """region_id, read_id, grp, log_m, log_u: certain calls seen in runs of ``run`` groups.

    A run begins with probability ``start`` at each group at least ``gap`` past the last run.
    """

    def draw(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng(zlib.crc32(f"{r.region_id}{seed}".encode()))
                x = ising.sample(r.alpha, np.asarray(r.beta, float), reads, rng)
                since = np.full(reads, run + gap)
                seen = np.zeros(x.shape, bool)
                for g in range(x.shape[1]):
                    since = np.where((rng.random(reads) < start) & (since >= run + gap), 0, since) + 1
                    seen[:, g] = since <= run
                i, g = np.nonzero(seen)
                up = x[i, g] == 1
                yield pd.DataFrame({"region_id": r.region_id, "read_id": [f"{r.region_id}:{k}" for k in i], "grp": g + 1, "log_m": np.where(up, 0.0, -50.0), "log_u": np.where(up, -50.0, 0.0)})

    return models.select("region_id", "alpha", "beta").mapInPandas(draw, "region_id string, read_id string, grp int, log_m double, log_u double")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 17) -> DataFrame:
    """``n`` rows without replacement, the same ones at every run: those of least hash of ``keys``."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("__order", order).orderBy("__order", *keys).limit(n).drop("__order")
