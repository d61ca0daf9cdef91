"""Simulation studies: power and null behaviour of the tests, and what the noise model gains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions.scalars import binarise
from strandloom.operators import comparison, models, simulation
from strandloom.plans.pipelines import analysis_pieces
from strandloom.session import ship


def _keys(spark: SparkSession, reps: int, phi1, phi2) -> DataFrame:
    """region_id, phi1, phi2, truth: ``reps`` regions with the effect and as many without."""
    both = spark.range(2 * reps).withColumn("truth", F.col("id") < reps)
    one, two = (F.array(*[F.lit(float(x)) for x in p]) for p in (phi1, phi2))
    return both.select(F.concat_ws("_", F.lit("sim"), "id").alias("region_id"), one.alias("phi1"), F.when(F.col("truth"), two).otherwise(one).alias("phi2"), "truth")


def group_study(spark: SparkSession, reps: int, replicates: int, phi1, phi2, noise: float = 1.0, reads: int | None = None, sd: float = 2.0, config: Config = Config(max_em_init=5, max_em_iters=25)) -> DataFrame:
    """truth, region_id, test, start, end, stat, p of the group tests on simulated replicates.

    ``reads``: each replicate is fitted anew to that many simulated reads, and regions with a
    replicate that couldn't be fitted go; None: the true models are compared. Divergences have no p here.
    """
    ship(spark)
    keys = _keys(spark, reps, phi1, phi2)
    true, sites = simulation.group_models(spark, keys, replicates, replicates, noise, seed=config.seed)
    if reads is not None:
        unit = models.alphas(true).withColumn("region_id", F.concat_ws("#", "region_id", "sample"))
        calls = models.simulate_calls(unit, reads, sd, seed=config.seed)
        seen = unit.select("region_id", F.explode(F.sequence(F.lit(0), F.lit(reads - 1))).alias("k")).select("region_id", F.concat_ws(":", "region_id", "k").alias("read_id"))
        fits = models.fit_regions(calls, unit, seen, config.max_em_init, config.max_em_iters, config.seed).where("converged")
        part = F.split("region_id", "#")
        found = fits.select(part[0].alias("region_id"), part[1].cast("int").alias("sample"), "phi")
        whole = found.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2 * replicates).select("region_id")
        true = true.drop("phi").join(found, ["region_id", "sample"]).join(whole, "region_id", "left_semi")
    pieces = analysis_pieces(sites.select("region_id", "chr", "chrst", "chrend", "pos"), config.max_size_subreg + 1)
    full = models.alphas(true).join(pieces, "region_id")
    s = models.summaries(full, ("region_id", "sample", "grp")).join(pieces.select("region_id", "starts", "ends"), "region_id")
    values = s.select("region_id", F.col("sample").cast("int").alias("sample"), F.col("grp").cast("int").alias("grp"), F.posexplode(F.arrays_zip("starts", "ends", "mml", "nme")).alias("k", "v"))
    values = values.select("region_id", "sample", "grp", "k", F.col("v.starts").alias("start"), F.col("v.ends").alias("end"), "v.mml", "v.nme").where("mml is not null")
    by = ["region_id", "k", "start", "end"]
    out = None
    for test, col in (("tmml", "mml"), ("tnme", "nme")):
        if config.matched:
            side = lambda g, c=col: F.max(F.when(F.col("grp") == g, F.col(c)))
            d = values.groupBy(*by, (F.col("sample") % replicates).alias("i")).agg((side(1) - side(2)).alias("x"))
            t = comparison.matched_test(d, by)
        else:
            t = comparison.unmatched_test(values.withColumns({"i": F.col("sample"), "x": F.col(col)}), by)
        t = t.select(F.lit(test).alias("test"), *by, "stat", "p")
        out = t if out is None else out.unionByName(t)
    return out.join(keys.select("region_id", "truth"), "region_id").select("truth", "region_id", "test", "start", "end", "stat", "p")


def noise_study(spark: SparkSession, sds: list[float], reps: int, phi=(1.0, -5.0, 2.0), groups: int = 20, reads: int = 10, observed: float = 0.8, mean: float = 0.6, config: Config = Config(max_em_init=20, max_em_iters=100)) -> DataFrame:
    """sd, rep, model (noise or certain), mse of alpha and beta: what fitting with call likelihoods gains.

    Readings lie around -mean and mean with the given sd. Fits that don't converge have no row.
    """
    ship(spark)
    place = F.sequence(F.lit(1), F.lit(groups))
    rho = F.transform(place, lambda g: simulation.grid_uniform(0.001, 0.5, 0.001, config.seed, g))
    units = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sds)], "at int, sd double").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    base = units.select("at", "sd", "rep", F.array(*[F.lit(float(x)) for x in phi]).alias("phi"), F.transform(place, lambda g: F.lit(1.0)).alias("n"), rho.alias("rho"), F.transform(place, lambda g: F.when(g < groups, 10.0).otherwise(0.0)).alias("d"))
    base = models.alphas(base.withColumn("region_id", F.concat_ws("#", "at", "rep")))
    calls = None
    for i, s in enumerate(sds):  # a row per level of noise
        c = models.simulate_calls(base.where(F.col("at") == i), reads, float(s), observed, config.seed, mean)
        calls = c if calls is None else calls.unionByName(c)
    m, u = binarise(F.col("log_m"), F.col("log_u"))
    kinds = (("noise", calls), ("certain", calls.select("region_id", "read_id", "grp", m.alias("log_m"), u.alias("log_u"))))
    seen = base.select("region_id", F.explode(F.sequence(F.lit(0), F.lit(reads - 1))).alias("k")).select("region_id", F.concat_ws(":", "region_id", "k").alias("read_id"))
    out = None
    for kind, c in kinds:
        f = models.fit_regions(c, base, seen, config.max_em_init, config.max_em_iters, config.seed).where("converged").select("region_id", F.col("phi").alias("found"))
        f = f.withColumn("model", F.lit(kind))
        out = f if out is None else out.unionByName(f)
    both = base.join(out, "region_id")
    fitted = models.alphas(both.select("region_id", "model", F.col("found").alias("phi"), "n", "rho", "d")).select("region_id", "model", F.col("alpha").alias("a2"), F.col("beta").alias("b2"))
    gap = F.zip_with(F.concat("alpha", "beta"), F.concat("a2", "b2"), lambda x, y: (x - y) * (x - y))
    mse = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(gap)
    return base.join(fitted, "region_id").select("sd", "rep", "model", mse.alias("mse"))
