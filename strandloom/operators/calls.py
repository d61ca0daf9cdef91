"""Calls of reads on groups: joins, filters and sample averages, all in DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.config import FLAGS, LOG_RIGHT, LOG_WRONG, MIN_MAPQ
from strandloom.functions.scalars import binary_entropy, binarise, call_sign
from strandloom.operators.genome import overlap_join


def calls_in_regions(calls: DataFrame, regions: DataFrame, width: int = 8192) -> DataFrame:
    """Calls with each region that their raw 0-based interval overlaps."""
    return overlap_join(calls, regions, "chr", "start", "end", "chrst", "chrend", width)


def region_reads(in_regions: DataFrame) -> DataFrame:
    """region_id, read_id: also reads none of whose calls match a group."""
    return in_regions.select("region_id", "read_id").distinct()


def calls_on_groups(in_regions: DataFrame, groups: DataFrame, order: str = "start", certain: bool = False) -> DataFrame:
    """region_id, read_id, grp, log_m, log_u: calls whose first and last C are those of a group.

    Of several calls of a read on a group the last by ``order`` counts. ``certain``: every call
    is taken as sure.
    """
    on = ["region_id", "first_pos", "last_pos"]
    keyed = in_regions.withColumns({"first_pos": F.col("start") + 1, "last_pos": F.col("end") + 1})
    hit = keyed.join(groups.select("region_id", "grp", "first_pos", "last_pos"), on)
    last = hit.groupBy("region_id", "read_id", "grp").agg(F.max_by(F.struct("log_m", "log_u"), order).alias("v")).select("region_id", "read_id", "grp", "v.log_m", "v.log_u")
    if certain:
        m, u = binarise(F.col("log_m"), F.col("log_u"))
        last = last.select("region_id", "read_id", "grp", m.alias("log_m"), u.alias("log_u"))
    return last


def coverage_filter(calls: DataFrame, groups: DataFrame, min_cov: float = 10.0, min_perc: float = 0.66, min_sites: int = 10) -> DataFrame:
    """region_id, depth, perc_obs of regions with enough sites, groups, depth and observed groups."""
    sizes = groups.groupBy("region_id").agg(F.count(F.lit(1)).alias("l"), F.sum("n_cpg").alias("n_cpg")).where((F.col("n_cpg") >= min_sites) & (F.col("l") > 1))
    seen = calls.groupBy("region_id", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("region_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("observed"))
    both = seen.join(sizes, "region_id").select("region_id", (F.col("n") / F.col("l")).alias("depth"), (F.col("observed") / F.col("l")).alias("perc_obs"))
    return both.where((F.col("depth") >= min_cov) & (F.col("perc_obs") >= min_perc))


def sample_ex(calls: DataFrame) -> DataFrame:
    """region_id, grp, ex: the mean sign of a group's calls."""
    return calls.groupBy("region_id", "grp").agg(F.avg(call_sign(F.col("log_m"), F.col("log_u"))).alias("ex"))


def sample_exx(calls: DataFrame) -> DataFrame:
    """region_id, grp, exx: the mean product of the signs of a group and the next in one read."""
    by = W.partitionBy("region_id", "read_id").orderBy("grp")
    s = calls.select("region_id", "read_id", "grp", call_sign(F.col("log_m"), F.col("log_u")).alias("s"))
    pair = s.select("region_id", "grp", "s", F.lead("s").over(by).alias("s2"), F.lead("grp").over(by).alias("g2"))
    return pair.where("g2 = grp + 1").groupBy("region_id", "grp").agg(F.avg(F.col("s") * F.col("s2")).alias("exx"))


def site_averages(sites: DataFrame, ex: DataFrame, exx: DataFrame) -> DataFrame:
    """Group averages on their sites (region_id, pos, grp): within a group the product is 1."""
    by = W.partitionBy("region_id").orderBy("pos")
    s = sites.withColumns({"next_pos": F.lead("pos").over(by), "next_grp": F.lead("grp").over(by)})
    return s.join(ex, ["region_id", "grp"], "left").join(exx, ["region_id", "grp"], "left").withColumn("exx", F.when(F.col("next_grp") == F.col("grp"), F.when(F.col("ex").isNotNull(), 1.0)).when(F.col("next_grp") == F.col("grp") + 1, F.col("exx"))).drop("next_grp")


def marginal_model(calls: DataFrame) -> DataFrame:
    """region_id, grp, p: share of calls with m >= u."""
    return calls.groupBy("region_id", "grp").agg(F.avg(F.when(F.col("log_m") - F.col("log_u") >= 0, 1.0).otherwise(0.0)).alias("p"))


def marginal_summaries(p: DataFrame, keys: list[str]) -> DataFrame:
    """Mean p and mean binary entropy by ``keys``."""
    return p.groupBy(*keys).agg(F.avg("p").alias("mml"), F.avg(binary_entropy(F.col("p"))).alias("nme"))


def usable_alignments(records: DataFrame) -> DataFrame:
    return records.where(F.col("xm").isNotNull() & ~F.col("has_xs") & F.col("flag").isin(*FLAGS) & (F.col("mapq") > MIN_MAPQ))


def mate_pairs(records: DataFrame, keys: tuple[str, ...] = ("qname",)) -> DataFrame:
    """keys, r1, r2 (by position) of templates with exactly two records."""
    g = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "flag", "xm")).alias("r1"), F.max(F.struct("pos", "flag", "xm")).alias("r2"))
    return g.where("n = 2").select(*keys, "r1", "r2")


def _trimmed(xm: Column, left: int, right: int) -> Column:
    return F.when(F.length(xm) > left + right, xm.substr(F.lit(left + 1), F.length(xm) - left - right)).otherwise("")


def paired_calls(records: DataFrame, trim: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """qname, chr, pos (of the C), log_m, log_u of templates of two mates; others go.

    The first mate by position covers its whole stretch, called or not; the second counts past its
    end. ``trim``: ends cut off the first mate (left, right) and the second (right, left). Flags
    other than 99/147 and 83/163 raise.
    """
    pairs = mate_pairs(records, ("qname", "chr"))
    low, high = F.least("r1.flag", "r2.flag"), F.greatest("r1.flag", "r2.flag")
    flags = F.concat(F.lit("unexpected flags "), low.cast("string"), F.lit("/"), high.cast("string"))
    shift = F.when((low == 99) & (high == 147), 0).when((low == 83) & (high == 163), -1).otherwise(F.raise_error(flags).cast("int"))
    one, two = _trimmed(F.col("r1.xm"), trim[0], trim[1]), _trimmed(F.col("r2.xm"), trim[3], trim[2])
    start, other = F.col("r1.pos") + trim[0], F.col("r2.pos") + trim[3]
    spread = lambda text, at: F.transform(F.split(text, ""), lambda c, i: F.struct((at + i).alias("pos"), c.alias("c")))
    rest = F.filter(spread(two, other), lambda x: x.pos >= start + F.length(one))
    seen = pairs.select("qname", "chr", shift.alias("shift"), F.explode(F.filter(F.concat(spread(one, start), rest), lambda x: x.c.isin("Z", "z"))).alias("x"))
    m = F.when(F.col("x.c") == "Z", LOG_RIGHT).otherwise(LOG_WRONG)
    u = F.when(F.col("x.c") == "Z", LOG_WRONG).otherwise(LOG_RIGHT)
    return seen.select("qname", "chr", (F.col("x.pos") + F.col("shift")).alias("pos"), m.alias("log_m"), u.alias("log_u"))


def bisulfite_calls(records: DataFrame, trim: tuple[int, int] = (0, 0)) -> DataFrame:
    """qname, chr, pos (of the C), log_m, log_u from XM strings: Z methylated, z not."""
    t5, t3 = trim
    body = F.substring(F.col("xm"), 1, 1 << 30)
    cut = _trimmed(body, t5, t3)
    top = F.col("flag").isin(0, 99, 147)
    offset = F.when(top, 0).otherwise(-1)
    each = records.select("qname", "chr", "flag", (F.col("pos") + t5 + offset).alias("base"), F.posexplode(F.split(cut, "")).alias("i", "c")).where(F.col("c").isin("Z", "z"))
    m = F.when(F.col("c") == "Z", 0.0).otherwise(-50.0)
    # where mates overlap the first one counts
    rows = each.select("qname", "chr", (F.col("base") + F.col("i")).alias("pos"), m.alias("log_m"), (-50.0 - m).alias("log_u"), "base")
    return rows.groupBy("qname", "chr", "pos").agg(F.min_by(F.struct("log_m", "log_u"), "base").alias("v")).select("qname", "chr", "pos", "v.log_m", "v.log_u")
