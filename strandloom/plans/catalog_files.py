"""Queries over files: tables written in the formats of the field, read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import scalars
from strandloom.operators import calls, genome
from strandloom.plans.catalog import _GROUPS, _groups
from strandloom.plans.registry import as_text, query, rounded, table, written
from strandloom.sources import bam, readers, writers


@query("select n_name as chr, n_nationkey * 1000 + 500 as length, n_nationkey * 7 as offset, 50 as linebases, 51 as linewidth from nation")
def fai_records(spark, d):
    n = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 1000 + 500).alias("l"), (F.col("n_nationkey") * 7).alias("o"), F.lit(50).alias("b"), F.lit(51).alias("w"))
    return readers.read_fai(spark, as_text(n, written(spark, "fai")))


def _fasta(spark, d) -> DataFrame:
    """Documents as records of lines of text; what begins a record is left out of them."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), ">", "")
    return readers.read_fasta(spark, as_text(table(spark, d, "documents").select(F.concat(F.lit(">d"), "doc_id", F.lit(" a name\n"), body).alias("v")), written(spark, "fasta")))


_SEQ = r"regexp_replace(replace(coalesce(text, ''), '>', ''), '[ \t\n\x0b\f\r]+', '', 'g')"


@query(f"select 'd' || doc_id as chr, length({_SEQ}) as length, md5({_SEQ}) as seq from documents")
def fasta_records(spark, d):
    return _fasta(spark, d).select("chr", "length", F.md5(F.encode("seq", "UTF-8")).alias("seq"))


@query(f"select 'd7' as chr, 11 as start, least(90, length({_SEQ})) as end, substr({_SEQ}, 11, 80) as seq from documents where doc_id = 7")
def fasta_window(spark, d):
    return readers.fasta_window(_fasta(spark, d), "d7", 11, 90)


@query("select n_name as chr, n_nationkey * 100 as start, n_nationkey * 100 + n_regionkey * 50 - 50 as end from nation where n_regionkey > 0")
def bed_records(spark, d):
    n = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 100).alias("s"), (F.col("n_nationkey") * 100 + F.col("n_regionkey") * 50 - 50).alias("e"))
    return readers.read_bed(spark, as_text(n, written(spark, "bed")))


def _call_file(spark, d) -> DataFrame:
    """A call table of lines: a header in each file, and a column more than is read."""
    path = written(spark, "calls")
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("chromosome"), F.lit("+").alias("strand"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + 4).alias("end"), F.concat(F.lit("r"), "l_orderkey", F.lit("."), "l_linenumber").alias("read_name"),
        (F.col("l_discount") - F.col("l_tax")).alias("ratio"), F.col("l_discount").alias("lm"), F.col("l_tax").alias("lu"), F.lit(1).alias("n"),
    )
    rows.write.csv(path, sep="\t", header=True)
    return readers.read_calls(spark, path)


@query("select l_returnflag as chr, read_id, start, chrst, log_m, log_u from (select *, l_partkey * 10 start, 'r' || l_orderkey || '.' || l_linenumber read_id, l_discount log_m, l_tax log_u from lineitem) l, (select i * 900 chrst from range(0, 30) t(i)) r where start <= chrst + 500 and start + 4 >= chrst")
def calls_in_regions(spark, d):
    starts = spark.range(30).select((F.col("id") * 900).alias("chrst"), (F.col("id") * 900 + 500).alias("chrend"))
    flags = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("chr")).distinct()
    regions = flags.withColumn("s", F.lit(1)).join(starts.withColumn("s", F.lit(1)), "s").drop("s")  # three flags, thirty windows
    return calls.calls_in_regions(_call_file(spark, d), regions).select("chr", "read_id", "start", "chrst", "log_m", "log_u")


def _model_file(spark, d) -> str:
    """Models of parts: phi of three numbers, one missing now and then; some without alpha and beta."""
    p = table(spark, d, "part")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("NaN"))
    phi = F.concat_ws(",", number(F.col("p_size") / 4), number(F.col("p_retailprice") / 100), number(F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 10)))
    key = [F.col("p_brand").alias("chr"), (F.col("p_partkey") * 100).alias("chrst"), (F.col("p_partkey") * 100 + 99).alias("chrend"), phi.alias("phi")]
    alpha = F.concat_ws(",", number(F.col("p_size") / 50), number(F.lit(-0.5)), number(F.col("p_size") / -40))
    beta = F.concat_ws(",", number(F.lit(0.25)), number(F.lit(0.5)))
    path = written(spark, "models")
    as_text(p.where("p_size % 5 <> 0").select(*key, alpha.alias("a"), beta.alias("b")), f"{path}/full")
    as_text(p.where("p_size % 5 = 0").select(*key), f"{path}/bare")
    return path


_MODELS = "select p_brand as chr, p_partkey * 100 as chrst, p_partkey * 100 + 99 as chrend, p_brand || '_' || (p_partkey * 100) || '_' || (p_partkey * 100 + 99) as region_id, p_size / 4.0 as phi0, p_retailprice / 100 as phi1, case when p_size % 7 <> 0 then p_size / 10.0 end as phi2, case when p_size % 5 <> 0 then p_size / 50.0 end as alpha0, case when p_size % 5 <> 0 then p_size / -40.0 end as alpha2, case when p_size % 5 <> 0 then 2 end as n_beta from part"


def _models_read(spark, d) -> DataFrame:
    path = _model_file(spark, d)
    return readers.read_models(spark, [f"{path}/full", f"{path}/bare"])


@query(f"select region_id, round(phi0::double, 6) as phi0, round(phi1, 6) as phi1, round(phi2::double, 6) as phi2, round(alpha0::double, 6) as alpha0, round(alpha2::double, 6) as alpha2, n_beta from ({_MODELS})")
def model_records(spark, d):
    m = _models_read(spark, d)
    one = lambda c, i, n: rounded(F.get(c, F.lit(i))).alias(n)
    return m.select("region_id", *[one("phi", i, f"phi{i}") for i in range(3)], one("alpha", 0, "alpha0"), one("alpha", 2, "alpha2"), F.when(F.col("beta").isNotNull(), F.size("beta")).alias("n_beta"))


@query(f"select chr, chrst, chrend, region_id from ({_MODELS}) where chrst % 300 = 0")
def models_on_partition(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("chr"), (F.col("p_partkey") * 100).alias("chrst"), (F.col("p_partkey") * 100 + 99).alias("chrend")).where("chrst % 300 = 0")
    return readers.models_on_partition(_models_read(spark, d), part).select("chr", "chrst", "chrend", "region_id")


def _site_rows(spark, d) -> DataFrame:
    """Sites of parts with averages that are missing now and then."""
    return table(spark, d, "part").select(
        F.col("p_brand").alias("chr"), F.lit(1).cast("long").alias("chrst"), F.lit(10**6).cast("long").alias("chrend"), (F.col("p_partkey") * 5).alias("pos"), F.when(F.col("p_size") % 3 != 0, F.col("p_partkey") * 5 + 9).alias("next_pos"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") / 25 - 1).alias("ex"), F.when(F.col("p_size") % 6 != 0, F.col("p_retailprice") / 4000).alias("exx"),
    )


@query("select p_brand as chr, p_partkey * 5 as start, p_partkey * 5 as end, round(p_size / 25.0 - 1, 6) as value from part where p_size % 4 <> 0")
def ex_records(spark, d):
    path = written(spark, "ex")
    writers.write_ex(_site_rows(spark, d), path)
    return readers.read_levels(spark, path).withColumn("value", rounded("value"))


@query("select p_brand as chr, p_partkey * 5 as start, p_partkey * 5 + 9 as end, round(p_retailprice / 4000, 6) as value from part where p_size % 6 <> 0 and p_size % 3 <> 0")
def exx_records(spark, d):
    path = written(spark, "exx")
    writers.write_exx(_site_rows(spark, d), path)
    return readers.read_levels(spark, path).withColumn("value", rounded("value"))


@query("""with a as (select p_brand chr, p_partkey * 5 pos, case when p_size / 25.0 - 1 >= 1 then 20 when p_size / 25.0 - 1 <= -1 then -20 else 0.5 * ln((p_size / 25.0) / (2 - p_size / 25.0)) end a, p_size % 4 <> 0 seen from part)
select chr || '_1_1000000' as region_id, cast(n as int) as n, round(alpha, 6) as alpha from (select chr, row_number() over (partition by chr order by pos) - 1 n, case when seen then a end alpha from a)""")
def marginal_model_records(spark, d):
    path = written(spark, "theta")
    writers.write_models(writers.marginal_models(_site_rows(spark, d)), path)
    m = readers.read_models(spark, path)
    return m.select("region_id", F.posexplode("alpha").alias("n", "alpha")).select("region_id", "n", rounded("alpha").alias("alpha"))


def _level_rows(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("chr"), (F.col("p_partkey") * 5).alias("start"), (F.col("p_partkey") * 5 + 4).alias("end"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice") / 1024).alias("mml"), (F.col("p_size") / 64).alias("nme"))


@query("select p_brand as chr, p_partkey * 5 as start, p_partkey * 5 + 4 as end, round_even(p_retailprice / 1024, 4) as value from part where p_size % 4 <> 0")
def mml_records(spark, d):
    path = written(spark, "mml")
    writers.write_level(_level_rows(spark, d), "mml", path)
    return readers.read_levels(spark, path)


@query("select p_brand as chr, p_partkey * 5 as start, p_partkey * 5 + 4 as end, round_even(p_size / 64.0, 4) as value from part")
def nme_records(spark, d):
    path = written(spark, "nme")
    writers.write_level(_level_rows(spark, d), "nme", path)
    return writers.sort_levels(readers.read_levels(spark, path))


@query("""select 'ex' as kind, count(*) as n from part where p_size % 4 <> 0 union all select 'exx', count(*) from part where p_size % 6 <> 0 and p_size % 3 <> 0
union all select 'mml', count(*) from part where p_size % 4 <> 0 union all select 'nme', count(*) from part union all select 'theta', count(*) from part""")
def all_outputs(spark, d):
    prefix = f"{written(spark, 'all')}/x"
    m = _models_read(spark, d).select("chr", "chrst", "chrend", "phi", "alpha", "beta")
    writers.write_outputs(m, _site_rows(spark, d), _level_rows(spark, d), prefix)
    out = None
    for path, kind in zip(writers.output_paths(prefix), ("theta", "ex", "exx", "mml", "nme"), strict=True):
        n = spark.read.text(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def _diff_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    test = F.get(F.array(*map(F.lit, writers.TESTS)), (F.col("o_orderkey") % 3).cast("int"))
    p = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") / 2048)
    return o.select(test.alias("test"), F.col("o_orderstatus").alias("chr"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 9).alias("end"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 65536 - 1).alias("stat"), p.alias("p"), p.alias("q"))


@query("""select ['tmml', 'tnme', 'tcmd'][o_orderkey % 3 + 1] as test, o_orderstatus as chr, o_orderkey as start, o_orderkey + 9 as end, round_even(case when o_orderkey % 3 = 2 then greatest(o_totalprice / 65536 - 1, 0) else o_totalprice / 65536 - 1 end, 4) as stat,
round(case when o_orderkey % 4 <> 0 then o_custkey / 2048.0 end, 6) as p from orders where o_orderkey % 7 <> 0""")
def diff_records(spark, d):
    prefix = f"{written(spark, 'diff')}/x"
    writers.write_diff(_diff_rows(spark, d), prefix)
    out = None
    for test, path in zip(writers.TESTS, writers.output_paths(prefix, writers.TESTS), strict=True):
        one = readers.read_diff(spark, path).select(F.lit(test).alias("test"), "chr", "start", "end", "stat", rounded("p").alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select cast(doc_id % 5 as varchar) as chr, w as window, count(*) as n from (select doc_id, unnest(range((doc_id * 37) // 5000, (doc_id * 37 + greatest(length(text), 1) - 1) // 5000 + 1)) w from documents) group by 1, 2")
def records_by_window(spark, d):
    path = written(spark, "windows")
    r = table(spark, d, "documents").select((F.col("doc_id") % 5).cast("string").alias("chr"), (F.col("doc_id") * 37 + 1).alias("pos"), F.col("text").alias("xm"))
    writers.split_windows(r, 5000, path)
    return spark.read.schema("pos long, xm string, chr string, window long").parquet(path).groupBy("chr", "window").agg(F.count(F.lit(1)).alias("n"))


#: Marks of alignments, by lines: methylated, not, other bases.
_XM = ("Z..z", ".zZ", "..", "z", "Zz.Z")


def _alignments(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    flag = F.get(F.array(*[F.lit(x) for x in (0, 16, 4, 99, 147, 83, 163)]), (F.col("l_partkey") % 7).cast("int"))
    xm = F.get(F.array(*map(F.lit, _XM)), (F.col("l_suppkey") % 5).cast("int"))
    rows = line.select(
        F.concat(F.lit("q"), "l_orderkey", F.lit("."), "l_linenumber", F.lit("."), "l_partkey", F.lit("."), "l_suppkey").alias("q"), flag.alias("f"), F.col("l_returnflag").alias("c"), (F.col("l_partkey") * 3).alias("p"), (F.col("l_quantity").cast("int") + 20).alias("m"),
        *[F.lit("*").alias(f"x{i}") for i in range(6)], F.concat(F.lit("XM:Z:"), xm).alias("xm"), F.when(F.col("l_suppkey") % 11 == 0, "XS:i:1").otherwise("NM:i:0").alias("tag"),
    )
    return readers.read_sam(spark, as_text(rows, written(spark, "sam")))


_SAM = "(select 'q' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey qname, [0, 16, 4, 99, 147, 83, 163][l_partkey % 7 + 1] flag, l_returnflag chr, l_partkey * 3 as pos, cast(floor(l_quantity) as int) + 20 mapq, ['Z..z', '.zZ', '..', 'z', 'Zz.Z'][l_suppkey % 5 + 1] xm, l_suppkey % 11 = 0 has_xs from lineitem)"


@query(f"select * from {_SAM} where not has_xs and flag <> 4 and mapq > 39")
def usable_alignments(spark, d):
    return calls.usable_alignments(_alignments(spark, d))


@query(f"select * from {_SAM} where chr = 'A' and pos <= 900 and pos + length(xm) - 1 >= 600")
def records_in_window(spark, d):
    return bam.overlapping(_alignments(spark, d), "A", 600, 900)


@query(f"""with r as (select distinct on (qname) * from {_SAM} where not has_xs and flag <> 4 and mapq > 39 order by qname), x as (select *, unnest(range(1, length(xm) + 1)) i from r)
select qname, chr, pos + i - 1 - case when flag in (0, 99, 147) then 0 else 1 end as pos, case substr(xm, i, 1) when 'Z' then 0.0 else -50.0 end::double as log_m, case substr(xm, i, 1) when 'Z' then -50.0 else 0.0 end::double as log_u from x where substr(xm, i, 1) in ('Z', 'z')""")
def bisulfite_calls(spark, d):
    return calls.bisulfite_calls(calls.usable_alignments(_alignments(spark, d)).dropDuplicates(["qname"]))


@query("select 'd' || doc_id as read_id, length(text) - length(replace(text, chr(10), '')) + 5 as length from documents")
def fastq_lengths(spark, d):
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 5
    rows = table(spark, d, "documents").select(F.concat(F.lit("@d"), "doc_id", F.lit(" x\n"), F.repeat(F.lit("A"), n.cast("int")), F.lit("\n+\n"), F.lit("@"), F.repeat(F.lit("!"), (n - 1).cast("int"))).alias("v"))
    return readers.read_fastq_lengths(spark, as_text(rows, written(spark, "fastq")))


@query("select case when l_quantity > 25 then 1 else -1 end as truth, round(l_discount, 6) as lr, case when l_discount > l_tax then 1 else -1 end as call, count(*) as n from lineitem where l_returnflag <> 'N' group by 1, 2, 3")
def caller_tuples(spark, d):
    path = written(spark, "tuples")
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 25, 1).otherwise(-1).alias("t"), F.when(F.col("l_returnflag") == "N", "n/a").otherwise(F.col("l_discount").cast("string")).alias("lr"), scalars.call_sign(F.col("l_discount"), F.col("l_tax")).alias("c"))
    rows.write.csv(path, sep="\t", compression="gzip")
    return readers.read_caller_tuples(spark, path).groupBy("truth", rounded("lr").alias("lr"), "call").agg(F.count(F.lit(1)).alias("n"))


@query(_GROUPS + """, r as (select doc_id, s chrst, least(s + 2999, n_chars) chrend from (select doc_id, n_chars, unnest(range(1, n_chars + 1, 3000)) s from documents))
select cast(g.doc_id as varchar) as chr, chrst, chrend, cast(sum(n_cpg) as bigint) as n_cpg, count(*) as n_groups from groups g join r on g.doc_id = r.doc_id and first_pos between chrst and chrend group by 1, 2, 3""")
def region_records(spark, d):
    path = written(spark, "regions")
    tiles = genome.tile_regions(table(spark, d, "documents"), "doc_id", "n_chars").withColumnRenamed("doc_id", "chr")
    writers.write_table(genome.region_table(tiles, _groups(spark, d).withColumnRenamed("doc_id", "chr")), path)
    return readers.read_regions(spark, path)


@query(_GROUPS + ", c as (select cast(n_cpg as int) bin, count(*) n from groups group by 1) select cast(r as int) as bin, coalesce(n, 0) as n from range(1, 101) t(r) left join c on c.bin = r")
def histogram_dump(spark, d):
    path = written(spark, "hist")
    h = genome.histogram(_groups(spark, d), F.col("n_cpg"), 100)
    writers.write_table(h.where("bin <= 50"), path)
    writers.write_table(h.where("bin > 50"), path, append=True)
    return spark.read.csv(path, sep="\t", schema="bin int, n long")


@query("select c_custkey, c_nationkey as start, c_custkey as end from customer where c_custkey % 3 > 0")
def parsed_ranges(spark, d):
    text = F.when(F.col("c_custkey") % 3 > 0, F.concat_ws(":", "c_nationkey", "c_custkey")).otherwise(F.col("c_name"))
    r = table(spark, d, "customer").select("c_custkey", scalars.parse_range(text).alias("r")).where("r is not null")
    return r.select("c_custkey", F.col("r.start").cast("int").alias("start"), F.col("r.end").alias("end"))
