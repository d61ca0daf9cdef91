"""Sinks: tab-separated text without header, sorted within files; null stands for not computed."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


log = logging.getLogger("strandloom")


TESTS = ("tmml", "tnme", "tcmd")


def refuse_existing(spark: SparkSession, paths: list[str]) -> None:
    """Raises if any of the outputs is there, before anything is computed or written."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            raise FileExistsError(f"output exists: {path}")


def output_paths(prefix: str, kinds: tuple[str, ...] = ("theta", "ex", "exx", "mml", "nme")) -> list[str]:
    return [f"{prefix}_{k}" for k in kinds]


def _write(df: DataFrame, path: str) -> None:
    """Refuses to overwrite: the mode is errorifexists."""
    log.info("writing %s", path)
    df.orderBy(*df.columns[:2]).write.mode("errorifexists").csv(path, sep="\t", header=False, nullValue="NaN")


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """Any table as tab-separated text: histograms and region tables, appended to or written anew."""
    df.write.mode("append" if append else "overwrite").csv(path, sep="\t", header=False, nullValue="NaN")


def sort_levels(df: DataFrame) -> DataFrame:
    """Intervals in order of chromosome and start, over all files."""
    return df.orderBy("chr", "start", "end")


def _csv(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), ",")


def write_ex(sites: DataFrame, path: str) -> None:
    """chr, pos, pos, E[X]."""
    _write(sites.where("ex is not null").select("chr", "pos", F.col("pos").alias("pos2"), "ex"), path)


def write_exx(sites: DataFrame, path: str) -> None:
    """chr, pos, next pos, E[XX]."""
    _write(sites.where("exx is not null and next_pos is not null").select("chr", "pos", "next_pos", "exx"), path)


def write_level(analysis: DataFrame, value: str, path: str) -> None:
    """chr, start, end, value to four places (ties to even): for mml and nme."""
    _write(analysis.where(F.col(value).isNotNull()).select("chr", "start", "end", F.bround(value, 4)), path)


def write_models(models: DataFrame, path: str) -> None:
    """chr, chrst, chrend, then phi, alpha, beta as comma lists."""
    _write(models.select("chr", "chrst", "chrend", _csv(F.col("phi")), _csv(F.col("alpha")), _csv(F.col("beta"))), path)


def marginal_models(sites: DataFrame) -> DataFrame:
    """Models of sample averages: no phi, alpha from E[X], no couplings."""
    from strandloom.functions.scalars import alpha_from_ex

    ordered = F.sort_array(F.collect_list(F.struct("pos", alpha_from_ex(F.col("ex")).alias("a"))))
    out = sites.groupBy("chr", "chrst", "chrend").agg(ordered.alias("s"))
    none = F.array(*[F.lit(None).cast("double")] * 3)
    return out.select("chr", "chrst", "chrend", none.alias("phi"), F.transform("s", lambda x: x.a).alias("alpha"), F.array_repeat(F.lit(0.0), F.size("s") - 1).alias("beta"))


def write_outputs(models: DataFrame, sites: DataFrame, analysis: DataFrame, prefix: str) -> None:
    """All five tables; none is written if any is there."""
    refuse_existing(models.sparkSession, output_paths(prefix))
    write_models(models, f"{prefix}_theta")
    write_ex(sites, f"{prefix}_ex")
    write_exx(sites, f"{prefix}_exx")
    write_level(analysis, "mml", f"{prefix}_mml")
    write_level(analysis, "nme", f"{prefix}_nme")


def write_diff(diff: DataFrame, prefix: str) -> None:
    """A file for each test: chr, start, end, stat, p, q; a negative tcmd is written as 0."""
    refuse_existing(diff.sparkSession, output_paths(prefix, TESTS))
    stat = F.bround(F.when(F.col("test") == "tcmd", F.greatest(F.col("stat"), F.lit(0.0))).otherwise(F.col("stat")), 4)
    for test in TESTS:
        _write(diff.where((F.col("test") == test) & F.col("stat").isNotNull()).select("chr", "start", "end", stat.alias("stat"), "p", "q"), f"{prefix}_{test}")


def split_reads(calls: DataFrame, files: int, path: str | None = None, seed: int = 0) -> DataFrame:
    """Adds bucket 0..files-1: reads, not rows, are dealt in a fixed pseudo-random order.

    Each file gets reads // files of them, the first one the rest as well. Places in the order
    come from counts of hash prefixes, so no task sorts all reads.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("read_id")))
    reads = calls.select("read_id").distinct().withColumn("order", order).withColumn("part", F.substring("order", 1, 3))
    counts = reads.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # at most 4096 rows
    ahead = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base"), F.sum("c").over(W.partitionBy(F.lit(0))).alias("total"))
    place = reads.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("order", "read_id")) - 1).join(F.broadcast(base), "part")
    share, rank = F.floor(F.col("total") / files), F.col("at") + F.col("base")
    first = share + F.col("total") % files
    bucket = F.when(rank < first, 0).otherwise(1 + F.floor((rank - first) / share)).cast("int")
    out = calls.join(place.select("read_id", bucket.alias("bucket")), "read_id")
    if path:
        out.write.mode("errorifexists").partitionBy("bucket").csv(path, sep="\t", header=True)
    return out


def split_windows(records: DataFrame, width: int, path: str) -> None:
    """Alignment records by the windows that they touch, as a folder of Parquet files a window."""
    by_window(records, width).write.mode("errorifexists").partitionBy("chr", "window").parquet(path)


def by_window(records: DataFrame, width: int) -> DataFrame:
    """Adds window: a record is repeated for each window that it touches."""
    end = F.col("pos") + F.greatest(F.length("xm"), F.lit(1)) - 1
    return records.withColumn("window", F.explode(F.sequence(F.floor((F.col("pos") - 1) / width), F.floor((end - 1) / width))))
