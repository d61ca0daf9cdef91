"""Readers of the text formats of methylation data. Missing numbers become null at ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.ranges import open_anywhere


def _tsv(spark: SparkSession, paths: str | list[str], schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(paths, sep="\t", schema=schema, header=header, nanValue="NaN", quote="")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "chr string, length long, offset long, linebases int, linewidth int")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chr, seq, length: a row per record. Records end at ``>``, whatever split they start in."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s+", "")
    return raw.select(F.split(F.trim(head), r"\s+")[0].alias("chr"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long"))


def fasta_windows(spark: SparkSession, path: str, windows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``windows`` (chr, start, end; others stay) with seq, their bases, cut at the end of the record.

    Only the bytes of a window are read: its place in the file comes from ``index`` (``read_fai``; ``path``.fai if
    not given). Windows of unknown records, or that begin before or behind theirs, go. An index that doesn't
    fit the file raises. The file must be readable from every executor.
    """
    from strandloom.session import ship

    ship(spark)
    index = read_fai(spark, path + ".fai") if index is None else index
    byte = lambda base: F.col("offset") + F.floor(base / F.col("linebases")) * F.col("linewidth") + base % F.col("linebases")
    place = index.select("chr", "length", "offset", F.col("linebases").cast("long").alias("linebases"), F.col("linewidth").cast("long").alias("linewidth"))
    inside = windows.join(place, "chr").withColumn("end", F.least("end", "length").cast("long")).where("start >= 1 and start <= end")
    rows = inside.select(*windows.columns, byte(F.col("start") - 1).alias("__from"), (byte(F.col("end") - 1) + 1).alias("__to"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__from", "__to").schema) + ", seq string"

    def run(batches):
        with open_anywhere(path) as f:
            for pdf in batches:
                at, seqs, held = 0, [], 0
                for first, to, a, b in zip(pdf["__from"], pdf["__to"], pdf["start"], pdf["end"], strict=True):
                    f.seek(int(first))
                    seqs.append(f.read(int(to - first)).translate(None, b"\r\n").decode("ascii"))
                    if len(seqs[-1]) != b - a + 1 or ">" in seqs[-1]:
                        raise ValueError(f"the index does not fit {path}")
                    held += len(seqs[-1])
                    if held >= 1 << 24:  # what is handed on at once stays small
                        yield pdf.iloc[at : at + len(seqs)].drop(columns=["__from", "__to"]).assign(seq=seqs)
                        at, seqs, held = at + len(seqs), [], 0
                yield pdf.iloc[at:].drop(columns=["__from", "__to"]).assign(seq=pd.Series(seqs, dtype=object, index=pdf.index[at:]))

    return rows.mapInPandas(run, schema)


def fasta_tiles(spark: SparkSession, path: str, tile: int = 1 << 16, reach: int = 0, index: DataFrame | None = None, part_bases: int = 1 << 25) -> DataFrame:
    """chr, tile (from 0), text: all records in tiles of ``tile`` bases that reach ``reach`` into the next.

    A record is nowhere whole; a task reads some ``part_bases`` of neighbouring tiles.
    """
    index = read_fai(spark, path + ".fai") if index is None else index
    parts = (index.agg(F.sum("length")).first()[0] or 0) // part_bases + 1
    starts = index.where("length > 0").select("chr", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(tile).cast("long"))).alias("start"))
    cut = starts.withColumn("end", F.col("start") + tile - 1 + reach).repartitionByRange(int(parts), "chr", "start")
    return fasta_windows(spark, path, cut, index).select("chr", F.floor((F.col("start") - 1) / tile).alias("tile"), F.col("seq").alias("text"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, end as they stand; rows that end before they start go."""
    return _tsv(spark, path, "chr string, start long, end long").where("end >= start")


def read_calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chr, start, end (0-based first and last C), read_id, log_m, log_u; extra columns are ignored."""
    names = "chr string, strand string, start long, end long, read_id string, ratio double, log_m double, log_u double"
    return _tsv(spark, path, names, header=True).select("chr", "start", "end", "read_id", "log_m", "log_u")


def read_models(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chr, chrst, chrend, region_id, phi, alpha, beta (arrays, null where the file has none), file."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.col("_metadata.file_path").alias("file"))
    numbers = lambda i: F.when(F.size("c") > i, F.transform(F.split(F.get("c", F.lit(i)), ","), lambda x: nan_to_null(x.cast("double"))))
    out = raw.where(F.size("c") >= 4).select(F.col("c")[0].alias("chr"), F.col("c")[1].cast("long").alias("chrst"), F.col("c")[2].cast("long").alias("chrend"), numbers(3).alias("phi"), numbers(4).alias("alpha"), numbers(5).alias("beta"), "file")
    return out.withColumn("region_id", F.concat_ws("_", "chr", "chrst", "chrend"))


def read_pore_model(spark: SparkSession, path: str) -> DataFrame:
    """kmer with the mean and sd of its plain and its methylated form: a full join of two projections."""
    raw = _tsv(spark, path, "kmer string, mean double, sd double", header=True)
    return merge_pore_model(raw)


def merge_pore_model(raw: DataFrame) -> DataFrame:
    plain = raw.where(~F.col("kmer").contains("M") & F.col("kmer").contains("C")).select("kmer", F.col("mean").alias("mean_u"), F.col("sd").alias("sd_u"))
    meth = raw.where(F.col("kmer").contains("M")).select(F.regexp_replace("kmer", "M", "C").alias("kmer"), F.col("mean").alias("mean_m"), F.col("sd").alias("sd_m"))
    return plain.join(meth, "kmer", "full_outer")


def read_fastq_lengths(spark: SparkSession, path: str) -> DataFrame:
    """read_id, length. A record starts at ``\\n@`` followed by a name line and is told by its four lines."""
    raw = spark.read.option("lineSep", "\n@").text(path).where(F.length("value") > 0)
    lines = F.split(F.col("value"), "\n")
    # a quality line may start with @ too: such a piece has no separator line
    return raw.where((F.size(lines) >= 3) & F.get(lines, F.lit(2)).startswith("+")).select(F.regexp_replace(F.split(lines[0], " ")[0], "^@", "").alias("read_id"), F.length(lines[1]).cast("long").alias("length"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, chr, pos, mapq, xm, has_xs of SAM text."""
    c = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("@")).withColumn("c", c)
    tags = F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0)))
    xm = F.filter(tags, lambda t: t.startswith("XM:Z:"))
    return raw.select(F.col("c")[0].alias("qname"), F.col("c")[1].cast("int").alias("flag"), F.col("c")[2].alias("chr"), F.col("c")[3].cast("long").alias("pos"), F.col("c")[4].cast("int").alias("mapq"), F.substring(F.get(xm, F.lit(0)), 6, 1 << 30).alias("xm"), F.exists(tags, lambda t: t.startswith("XS")).alias("has_xs"))


def read_caller_tuples(spark: SparkSession, path: str) -> DataFrame:
    """truth, lr, call; rows without a ratio go. gz files are read as they are."""
    return spark.read.csv(path, sep="\t", schema="truth int, lr double, call int", nullValue="n/a").dropna()


def read_levels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chr, start, end, value of mml, nme, E[X] and E[XX] files, packed or not."""
    return _tsv(spark, path, "chr string, start long, end long, value double").withColumn("value", nan_to_null(F.col("value")))


def read_diff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chr, start, end, stat, p, q of a test's file; files without q, or with NaN, give null."""
    raw = _tsv(spark, path, "chr string, start long, end long, stat double, p double, q double")
    return raw.select("chr", "start", "end", "stat", nan_to_null(F.col("p")).alias("p"), nan_to_null(F.col("q")).alias("q"))


def read_regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chr, chrst, chrend, n_cpg, n_groups of estimation regions."""
    return _tsv(spark, path, "chr string, chrst long, chrend long, n_cpg long, n_groups long")


def read_region_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pos, rho, d of the sites of a region, in order."""
    return _tsv(spark, path, "pos long, rho double, d long")


def fasta_window(sequences: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """chr, start, end, seq: the bases from ``start`` to ``end`` of one record of ``read_fasta``, cut at its ends."""
    one = sequences.where(F.col("chr") == chrom)
    return one.select("chr", F.lit(start).alias("start"), F.least(F.lit(end), F.col("length")).alias("end"), F.substring("seq", start, end - start + 1).alias("seq"))


def models_on_partition(models: DataFrame, partition: DataFrame) -> DataFrame:
    """``partition`` (chr, chrst, chrend) with the model of each region; a region without one raises."""
    keys = ["chr", "chrst", "chrend"]
    both = partition.select(*keys).join(models.withColumn("__has", F.lit(1)), keys, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no model for"), "chr", "chrst", "chrend")).cast("int")
    return both.where(F.coalesce("__has", missing) == 1).drop("__has")
