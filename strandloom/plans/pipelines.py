"""The entry points: analyses from files or DataFrames to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions.scalars import product_moment
from strandloom.operators import calls as C
from strandloom.operators import comparison, genome, models
from strandloom.session import settled, ship
from strandloom.sources import readers, writers


def _pluck(field: str):
    return F.transform("v", lambda x: x[field])


def genome_tables(sequences: DataFrame, config: Config, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """regions, sites (region_id, chr, pos, rho, d, grp), groups and profiles of ``sequences`` (chr, seq, length).

    ``targets`` (chr, start, end) restricts the partition; chromosomes without one drop out.
    """
    sites = genome.motif_positions(sequences, "chr", "seq").select("chr", "pos")
    if config.informme_mode:
        regions = genome.tile_regions(sequences, "chr", "length", config.size_est_reg)
    elif targets is not None:
        # one walk a target: its key carries the chromosome
        walk = targets.select(F.concat_ws("\t", "chr", "start", "end").alias("chr"), F.col("start").alias("first"), F.col("end").alias("last"), F.col("chr").alias("c"))
        near = walk.join(sites.withColumnRenamed("chr", "c"), "c").where("pos between first - 2000 and last + 2000").select("chr", "pos")
        regions = genome.chromosome_partition(near, walk, config.size_est_reg, config.min_grp_dist).withColumn("chr", F.split("chr", "\t")[0])
    else:
        sizes = sequences.select("chr", F.lit(1).cast("long").alias("first"), F.col("length").alias("last"))
        regions = genome.chromosome_partition(sites, sizes, config.size_est_reg, config.min_grp_dist)
    regions = regions.withColumn("region_id", F.concat_ws("_", "chr", "chrst", "chrend"))
    sized = regions.join(sequences.select("chr", "length"), "chr")
    inside = genome.region_density(sites, sized, F.col("length"))
    groups = genome.gap_groups(inside.select("region_id", "pos"), "region_id", config.min_grp_dist, block=None)
    by = W.partitionBy("region_id").orderBy("pos")
    gap = F.when(F.col("pos") - F.lag("pos").over(by) <= config.min_grp_dist, 0).otherwise(1)
    sites = inside.withColumn("new", gap).withColumn("grp", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")).drop("new")
    sites = genome.site_distances(sites, "region_id", None)
    rho = sites.groupBy("region_id", "grp").agg(F.avg("rho").alias("rho"))
    grouped = genome.group_distances(groups, "region_id", None).join(rho, ["region_id", "grp"])
    arrays = lambda df, order, n: df.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct(order, n.cast("double").alias("n"), F.col("rho"), F.coalesce(F.col("d_next").cast("double"), F.lit(0.0)).alias("d")))).alias("v")).select("region_id", *[_pluck(c).alias(c) for c in ("n", "rho", "d")])
    return {"regions": regions, "sites": sites, "groups": grouped, "by_group": arrays(grouped, "grp", F.col("n_cpg")), "by_site": arrays(sites, "pos", F.lit(1))}


def analysis_pieces(sites: DataFrame, max_size: int) -> DataFrame:
    """region_id, starts, ends, p, q: pieces of each region with their first and last site (from 0), null if empty."""
    regions = sites.groupBy("region_id", "chr").agg(F.first("chrst").alias("chrst"), F.first("chrend").alias("chrend"))
    pieces = genome.balanced_split(regions, "region_id", "chrst", "chrend", max_size)
    k = genome.assign_pieces(sites, F.col("chrst"), F.col("chrend"), max_size)
    k = k.withColumn("n", F.row_number().over(W.partitionBy("region_id").orderBy("pos")) - 1)
    ends = k.groupBy("region_id", "k").agg(F.min("n").alias("p"), F.max("n").alias("q"))
    full = pieces.withColumn("k", F.col("k").cast("int")).join(ends, ["region_id", "k"], "left")
    v = F.sort_array(F.collect_list(F.struct("k", "sub_start", "sub_end", F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q"))))
    return full.groupBy("region_id").agg(v.alias("v")).select("region_id", *[_pluck(c).alias(n) for n, c in (("starts", "sub_start"), ("ends", "sub_end"), ("p", "p"), ("q", "q"))])


def _observed(calls: DataFrame, tables: dict[str, DataFrame], config: Config) -> tuple[DataFrame, DataFrame]:
    """(calls on groups of well covered regions, their reads)."""
    hit = C.calls_in_regions(calls, tables["regions"])
    on = C.calls_on_groups(hit, tables["groups"], certain=not config.mod_nse)
    good = C.coverage_filter(on, tables["groups"], config.min_cov, config.min_perc_obs, config.min_sites).select("region_id")
    return on.join(good, "region_id", "left_semi"), C.region_reads(hit).join(good, "region_id", "left_semi")


def summarise(phi: DataFrame, tables: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """models, sites (ex, exx) and analysis (mml, nme) from phi by region, at the scale of sites."""
    pieces = analysis_pieces(tables["sites"], config.max_size_subreg + 1)
    model = models.alphas(phi.where("phi is not null").join(tables["by_site"], "region_id")).join(pieces, "region_id").join(tables["regions"], "region_id")
    s = models.summaries(model, ("region_id",)).drop("log_z").join(model.select("region_id", "chr", "starts", "ends"), "region_id")
    piece = F.posexplode(F.arrays_zip("starts", "ends", "mml", "nme")).alias("k", "v")
    analysis = s.select("region_id", "chr", piece).select("region_id", "chr", "k", F.col("v.starts").alias("start"), F.col("v.ends").alias("end"), "v.mml", "v.nme")
    by = W.partitionBy("region_id").orderBy("pos")
    numbered = tables["sites"].withColumns({"n": F.row_number().over(by) - 1, "next_pos": F.lead("pos").over(by)})
    sites = numbered.join(s.select("region_id", "ex", "exx"), "region_id").select("region_id", "chr", "chrst", "chrend", "pos", "next_pos", F.get("ex", F.col("n")).alias("ex"), F.get("exx", F.col("n")).alias("exx"))
    return {"models": model.select("region_id", "chr", "chrst", "chrend", "phi", "alpha", "beta"), "sites": sites, "analysis": analysis}


def analyze_nano(spark: SparkSession, calls: DataFrame, sequences: DataFrame, config: Config = Config(), targets: DataFrame | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """Fit every covered region and summarise it; written as five tables if ``out`` is given."""
    ship(spark)
    if out:
        writers.refuse_existing(spark, writers.output_paths(out))
    tables = genome_tables(sequences, config, targets)
    on, reads = _observed(calls, tables, config)
    phi = models.fit_regions(on, tables["by_group"], reads, config.max_em_init, config.max_em_iters, config.seed)
    # every result reads the fits, by far the dearest step
    result = summarise(settled(phi.where("converged")), tables, config)
    if out:
        writers.write_outputs(result["models"], result["sites"], result["analysis"], out)
    return result


#: Readers of call files by the name of the caller that wrote them.
CALLERS = {"nanopolish": readers.read_calls}


def read_calls_of(spark: SparkSession, path: str | list[str], config: Config) -> DataFrame:
    """Calls of a file by the caller that the settings name; an unknown one raises."""
    if config.caller not in CALLERS:
        raise ValueError(f"unknown caller: {config.caller}")
    return CALLERS[config.caller](spark, path)


def stored_moments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """region_id, ex, exx recomputed from the alpha and beta of model files."""
    ship(spark)
    return models.moments(readers.read_models(spark, path).where("alpha is not null and beta is not null")).select("region_id", "ex", "exx")


def yy_moments(sites: DataFrame) -> DataFrame:
    """Sites (region_id, pos, ex, exx) with E[YY'] of each with the next, y = (x + 1) / 2."""
    nxt = F.lead("ex").over(W.partitionBy("region_id").orderBy("pos"))
    return sites.withColumn("next_ex", nxt).where("next_ex is not null and exx is not null").withColumn("eyy", product_moment(F.col("ex"), F.col("next_ex"), F.col("exx"))).drop("next_ex")


def nano_smp_est(calls: DataFrame, sequences: DataFrame, config: Config = Config(), targets: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Sample averages on sites: DataFrame operators alone (but for the walk of the partition)."""
    ship(sequences.sparkSession)
    if out:
        writers.refuse_existing(sequences.sparkSession, writers.output_paths(out, ("ex", "exx", "theta")))
    tables = genome_tables(sequences, config, targets)
    on, _ = _observed(calls, tables, config)
    sites = C.site_averages(tables["sites"], C.sample_ex(on), C.sample_exx(on)).join(on.select("region_id").distinct(), "region_id", "left_semi")
    if out:
        writers.write_ex(sites, f"{out}_ex")
        writers.write_exx(sites, f"{out}_exx")
        writers.write_models(writers.marginal_models(sites), f"{out}_theta")
    return sites


def analyze_bisulfite(spark: SparkSession, records: DataFrame, sequences: DataFrame, config: Config = Config(min_grp_dist=1), targets: DataFrame | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """The same analysis of bisulfite alignments: each site is its own group."""
    usable = C.usable_alignments(records)
    found = C.paired_calls(usable, config.trim) if config.pe else C.bisulfite_calls(usable, config.trim[:2])
    as_calls = found.select("chr", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1).alias("end"), F.col("qname").alias("read_id"), "log_m", "log_u")
    return analyze_nano(spark, as_calls, sequences, config, targets, out)


def _site_models(files: DataFrame, sequences: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(models with alpha, beta, pieces; analysis values) of model rows (sample, grp, region)."""
    regions = files.select("chr", "chrst", "chrend", "region_id").distinct()
    sites = genome.motif_positions(sequences, "chr", "seq").select("chr", "pos")
    inside = genome.region_density(sites, regions.join(sequences.select("chr", "length"), "chr"), F.col("length"))
    sites = genome.site_distances(inside, "region_id", None)
    v = F.sort_array(F.collect_list(F.struct("pos", F.lit(1.0).alias("n"), "rho", F.coalesce(F.col("d_next").cast("double"), F.lit(0.0)).alias("d"))))
    by_site = sites.groupBy("region_id").agg(v.alias("v")).where(F.size("v") > 1).select("region_id", *[_pluck(c).alias(c) for c in ("n", "rho", "d")])
    full = settled(models.alphas(files.drop("alpha", "beta").join(by_site, "region_id")).join(analysis_pieces(sites, config.max_size_subreg + 1), "region_id"))
    s = models.summaries(full, ("sample", "grp", "region_id")).join(full.select("region_id", "chr", "starts", "ends").distinct(), "region_id")
    values = s.select("sample", "grp", "region_id", "chr", F.posexplode(F.arrays_zip("starts", "ends", "mml", "nme")).alias("k", "v")).select("sample", F.col("grp").cast("int").alias("grp"), "region_id", "chr", "k", F.col("v.starts").alias("start"), F.col("v.ends").alias("end"), "v.mml", "v.nme")
    return full, settled(values.where("mml is not null"))


def diff_grp_comp(spark: SparkSession, group1: list[str], group2: list[str], sequences: DataFrame, config: Config = Config(), out: str | None = None) -> DataFrame:
    """test, chr, start, end, stat, p, q of two groups of model files.

    Unmatched: differences of group means by relabelling, and the mean divergence. Matched:
    replicate i of either group is a pair.
    """
    ship(spark)
    if out:
        writers.refuse_existing(spark, writers.output_paths(out, writers.TESTS))
    parts = [readers.read_models(spark, f).withColumns({"sample": F.lit(i), "grp": F.lit(g), "rep": F.lit(i % len(group1) if g == 1 else i - len(group1))}) for g, files, at in ((1, group1, 0), (2, group2, len(group1))) for i, f in enumerate(files, at)]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    full, values = _site_models(files, sequences, config)
    keys = ["region_id", "chr", "k", "start", "end"]
    both = comparison.common_keys(values, keys)
    values = settled(values.join(both, keys, "left_semi"))
    out_tests = []
    pairs = models.model_pairs(full)
    cmd = settled(models.divergences(pairs).where("cmd is not null and not isnan(cmd)"))
    place = values.select(*keys).distinct()
    if config.matched:
        n1 = len(group1)
        rep = values.withColumn("i", F.when(F.col("grp") == 1, F.col("sample").cast("int")).otherwise(F.col("sample").cast("int") - n1))
        for test, col in (("tmml", "mml"), ("tnme", "nme")):
            d = rep.groupBy(*keys, "i").agg((F.max(F.when(F.col("grp") == 1, F.col(col))) - F.max(F.when(F.col("grp") == 2, F.col(col)))).alias("x")).where("x is not null")
            out_tests.append(comparison.matched_test(d, keys).select(F.lit(test).alias("test"), *keys, "stat", "p"))
        mine = comparison.mean_divergence(cmd.where(F.col("j") - F.col("i") == n1), ["region_id", "k"])
        out_tests.append(place.join(mine, ["region_id", "k"]).select(F.lit("tcmd").alias("test"), *keys, "stat", F.lit(None).cast("double").alias("p")))
    else:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("grp", F.col("sample").cast("int"))) - 1
        numbered = values.withColumn("i", rank)
        for test, col in (("tmml", "mml"), ("tnme", "nme")):
            t = comparison.unmatched_test(numbered.withColumn("x", F.col(col)), keys)
            out_tests.append(t.select(F.lit(test).alias("test"), *keys, "stat", "p"))
        members = values.select("region_id", "k", F.col("sample").cast("int").alias("sample"), "grp")
        t = comparison.divergence_test(cmd, members, ["region_id", "k"])
        out_tests.append(place.join(t, ["region_id", "k"]).select(F.lit("tcmd").alias("test"), *keys, "stat", "p"))
    diff = out_tests[0]
    for t in out_tests[1:]:
        diff = diff.unionByName(t)
    diff = comparison.bh(settled(diff.drop("region_id", "k")), ["test"])
    if out:
        writers.write_diff(diff, out)
    return diff


def diff_two_samp_comp(spark: SparkSession, model1: DataFrame, model2: DataFrame, calls1: DataFrame | None, calls2: DataFrame | None, sequences: DataFrame, config: Config = Config(), at_sites: bool = False, out: str | None = None) -> DataFrame:
    """test, chr, start, end, stat, p, q of two samples: absolute differences and divergence.

    ``at_sites``: the calls are of single sites, not of groups. ``out``: the tests are written.
    p by permuting reads between the samples: a task takes a region and a block of its
    permutations. Without calls p stays null.
    """
    ship(spark)
    if out:
        writers.refuse_existing(spark, writers.output_paths(out, writers.TESTS))

    def finish(tests: DataFrame) -> DataFrame:
        diff = comparison.bh(settled(tests.select("test", "chr", "start", "end", "stat", "p")), ["test"])
        if out:
            writers.write_diff(diff, out)
        return diff

    files = model1.withColumns({"sample": F.lit(0), "grp": F.lit(1)}).unionByName(model2.withColumns({"sample": F.lit(1), "grp": F.lit(2)}))
    common = comparison.common_keys(files, ["region_id"])
    files = files.join(common, "region_id", "left_semi")
    full, values = _site_models(files, sequences, config)
    observed = settled(_two_sample_stats(full, values))
    if calls1 is None or calls2 is None or not config.pval_comp:
        return finish(observed.withColumn("p", F.lit(None).cast("double")))
    tables = genome_tables(sequences, config)
    # at the scale of sites a group is a site: the profile is that of sites
    groups = tables["groups"] if not at_sites else tables["sites"].groupBy("region_id", "pos").agg(F.first("rho").alias("rho")).select("region_id", F.row_number().over(W.partitionBy("region_id").orderBy("pos")).alias("grp"), F.col("pos").alias("first_pos"), F.col("pos").alias("last_pos"), F.lit(1).cast("long").alias("n_cpg"), "rho")
    by_unit = tables["by_site"] if at_sites else tables["by_group"]
    both = []
    for side, calls in ((0, calls1), (1, calls2)):
        hit = C.calls_in_regions(calls.withColumn("read_id", F.concat(F.lit(f"{side}:"), "read_id")), tables["regions"].join(common, "region_id", "left_semi"))
        both.append((C.calls_on_groups(hit, groups, certain=not config.mod_nse), C.region_reads(hit)))
    on, reads = (both[0][i].unionByName(both[1][i]) for i in (0, 1))
    packed = models.packed_calls(on, reads)
    hits = models.permuted_hits(packed, by_unit, full.where("sample = 0"), observed, config.lmax_two_samp, config.max_em_init, config.max_em_iters, config.seed, config.perm_blocks, comparison.TIE)
    counted = observed.join(hits, ["region_id", "test", "k"], "left")
    p = F.when(F.col("n") > 20, (F.col("hits") + 1) / (F.col("n") + 1))
    return finish(counted.withColumn("p", p))


def _two_sample_stats(full: DataFrame, values: DataFrame) -> DataFrame:
    """test, region_id, chr, k, start, end, stat of two samples, one of either group."""
    keys = ["region_id", "chr", "k", "start", "end"]
    v = values.groupBy(*keys).agg(*[F.abs(F.max(F.when(F.col("grp") == 1, F.col(c))) - F.max(F.when(F.col("grp") == 2, F.col(c)))).alias(c) for c in ("mml", "nme")])
    long = v.select(*keys, F.explode(F.array(F.struct(F.lit("tmml").alias("test"), F.col("mml").alias("stat")), F.struct(F.lit("tnme").alias("test"), F.col("nme").alias("stat")))).alias("s")).select("s.test", *keys, "s.stat")
    side = lambda g, x: full.where(F.col("grp") == g).select("region_id", F.col("sample").alias(x), F.col("alpha").alias(f"alpha_{x}"), F.col("beta").alias(f"beta_{x}"), *(["p", "q"] if g == 1 else []))
    cmd = models.divergences(side(1, "i").join(side(2, "j"), "region_id"))
    c = v.select(*keys).join(cmd.select("region_id", "k", F.col("cmd").alias("stat")), ["region_id", "k"])
    return long.unionByName(c.select(F.lit("tcmd").alias("test"), *keys, "stat")).where("stat is not null and not isnan(stat)")
