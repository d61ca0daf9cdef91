"""The registered queries: the methylation operators on the driver's tables, with DuckDB SQL.

A text stands for a chromosome and the motif ``an`` for a site; orders are reads, their lines
the calls of a read on groups. Doubles are rounded: sums run in another order in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import scalars
from strandloom.operators import calls, comparison, evaluation, genome
from strandloom.plans.registry import ORACLES, QUERIES, Query
from strandloom.plans.registry import query as _query
from strandloom.plans.registry import rounded as _r
from strandloom.plans.registry import table as _t

MOTIF, WIDTH = "[Aa][Nn]", 2


_SITES = """with p as (select doc_id, string_split_regex(text, '[Aa][Nn]') s from documents),
q as (select doc_id, unnest(s) piece, generate_subscripts(s, 1) i, len(s) n from p),
sites as (select doc_id, i - 1 as n, cast(sum(length(piece) + 2) over (partition by doc_id order by i) - 1 as bigint) as pos from q where i < n)"""
_GROUPS = (
    _SITES
    + """, f as (select doc_id, pos, case when pos - lag(pos) over (partition by doc_id order by pos) <= 10 then 0 else 1 end nw from sites),
g as (select doc_id, pos, sum(nw) over (partition by doc_id order by pos) grp from f),
h as (select doc_id, cast(grp as int) grp, min(pos) first_pos, max(pos) last_pos, count(*) n_cpg from g group by 1, 2),
groups as (select doc_id, grp, first_pos - case when t = 1 then 0 else 5 end grp_start, last_pos + case when t = 1 then 0 else 5 end grp_end, n_cpg, first_pos, last_pos
 from (select *, sum(n_cpg) over (partition by doc_id) t from h))"""
)


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return genome.motif_positions(_t(spark, d, "documents"), "doc_id", "text", MOTIF, WIDTH)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return genome.gap_groups(_sites(spark, d), "doc_id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif_groups(spark, sf_dir)


@_query(_SITES + " select doc_id, n, pos from sites")
def motif_positions(spark, d):
    return _sites(spark, d)


@_query(_GROUPS + " select * from groups")
def motif_groups(spark, d):
    return _groups(spark, d)


@_query(_SITES + " select doc_id, pos, lead(pos) over (partition by doc_id order by pos) - pos as d_next from sites")
def motif_distance(spark, d):
    return genome.site_distances(_sites(spark, d), "doc_id").select("doc_id", "pos", "d_next")


@_query(_GROUPS + " select doc_id, grp, lead(first_pos) over (partition by doc_id order by grp) - last_pos as d_next from groups")
def group_distance(spark, d):
    return genome.group_distances(_groups(spark, d), "doc_id").select("doc_id", "grp", "d_next")


@_query(_SITES + " select doc_id, pos, round(count(*) over (partition by doc_id order by pos range between 501 preceding and 498 following) / 1000.0, 6) as rho from sites")
def motif_density(spark, d):
    return genome.site_density(_sites(spark, d), "doc_id").select("doc_id", "pos", _r("rho").alias("rho"))


@_query("select doc_id as chr, s as chrst, least(s + 2999, n_chars) as chrend from (select doc_id, n_chars, unnest(range(1, n_chars + 1, 3000)) s from documents)")
def tile_regions(spark, d):
    return genome.tile_regions(_t(spark, d, "documents"), "doc_id", "n_chars").withColumnRenamed("doc_id", "chr")


@_query("""with a as (select doc_id, n_chars sz, cast(ceil(n_chars / 351.0) as bigint) k from documents where n_chars > 0),
b as (select doc_id, sz, k, sz // k base, sz % k more, unnest(range(1, k + 1)) i from a)
select doc_id, i as k, case when i = 1 then 1 else base * (i - 1) + least(more, i - 1) end as sub_start, base * i + least(more, i) as sub_end from b""")
def balanced_split(spark, d):
    docs = _t(spark, d, "documents").where("n_chars > 0").select("doc_id", F.lit(1).cast("long").alias("st"), F.col("n_chars").alias("en"))
    return genome.balanced_split(docs, "doc_id", "st", "en")


@_query(_SITES + """, a as (select doc_id, n_chars sz, cast(ceil(n_chars / 351.0) as bigint) k from documents where n_chars > 0),
b as (select s.doc_id, pos, k, sz // k base, sz % k more from sites s join a using (doc_id))
select doc_id, pos, cast(least(case when pos < more * (base + 1) then pos // (base + 1) else more + (pos - more * (base + 1)) // base end, k - 1) + 1 as int) as k from b""")
def assign_pieces(spark, d):
    docs = _t(spark, d, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").alias("sz"))
    return genome.assign_pieces(_sites(spark, d).join(docs, "doc_id"), F.lit(1).cast("long"), F.col("sz")).select("doc_id", "pos", "k")


@_query(_GROUPS + """, r as (select doc_id, s chrst, least(s + 2999, n_chars) chrend from (select doc_id, n_chars, unnest(range(1, n_chars + 1, 3000)) s from documents))
select g.doc_id as chr, chrst, chrend, cast(sum(n_cpg) as bigint) as n_cpg, count(*) as n_groups from groups g join r on g.doc_id = r.doc_id and first_pos between chrst and chrend group by 1, 2, 3""")
def region_table(spark, d):
    return genome.region_table(tile_regions(spark, d), _groups(spark, d).withColumnRenamed("doc_id", "chr"))


#: For each place that a padded group covers, the group as it is seen from there (1000 bases to both sides).
_SEEN = """, near as (select g.doc_id, grp, first_pos, last_pos, n_chars as last, lag(last_pos) over w before, lead(first_pos) over w behind from groups g join documents using (doc_id) window w as (partition by g.doc_id order by grp)),
cover as (select *, unnest(range(first_pos - 5, last_pos + 6)) e from near),
marked as (select doc_id, pos, sum(nw) over (partition by doc_id order by pos) grp from f),
far as (select c.doc_id, c.e, min(s.pos) lo, max(s.pos) hi from cover c join marked s on s.doc_id = c.doc_id and s.grp = c.grp and s.pos between c.e - 1000 and least(c.last, c.e + 1000) where c.last_pos - c.first_pos > 900 group by 1, 2),
ends as (select c.doc_id, c.e, coalesce(far.lo, first_pos) lo, coalesce(far.hi, last_pos) hi, case when coalesce(far.hi, last_pos) > coalesce(far.lo, first_pos) or before >= c.e - 1000 or behind <= least(last, c.e + 1000) then 5 else 0 end pad from cover c left join far on far.doc_id = c.doc_id and far.e = c.e),
seen as (select doc_id, e, lo - pad lo, hi + pad hi from ends where e between lo - pad and hi + pad)"""


@_query("with recursive " + _GROUPS.removeprefix("with ") + _SEEN + """, walk as (select doc_id, cast(0 as bigint) a, cast(0 as bigint) b, n_chars as last from documents where n_chars > 1
 union all select w.doc_id, w.b + 1, case when w.b + 3000 >= w.last then w.last when s.e is null then w.b + 3000 when 2 * s.e - s.lo > s.hi then s.hi + 2 else s.lo - 1 end, w.last from walk w left join seen s on s.doc_id = w.doc_id and s.e = w.b + 3000 where w.b + 1 < w.last)
select cast(doc_id as varchar) as chr, a as chrst, b as chrend from walk where b > 0""")
def chromosome_partition(spark, d):
    sizes = _t(spark, d, "documents").where("n_chars > 0").select(F.col("doc_id").cast("string").alias("chr"), F.lit(1).alias("first"), F.col("n_chars").alias("last"))
    return genome.chromosome_partition(_sites(spark, d).select(F.col("doc_id").cast("string").alias("chr"), "pos"), sizes)


@_query(_GROUPS + ", c as (select cast(grp_end - grp_start + 1 as int) bin, count(*) n from groups group by 1) select cast(r as int) as bin, coalesce(n, 0) as n from range(1, 50001) t(r) left join c on c.bin = r")
def group_len_hist(spark, d):
    return genome.histogram(_groups(spark, d), F.col("grp_end") - F.col("grp_start") + 1, 50_000)


@_query(_GROUPS + ", c as (select cast(n_cpg as int) bin, count(*) n from groups group by 1) select cast(r as int) as bin, coalesce(n, 0) as n from range(1, 10001) t(r) left join c on c.bin = r")
def group_cpg_hist(spark, d):
    return genome.histogram(_groups(spark, d), F.col("n_cpg"), 10_000)


@_query(_GROUPS + ", r as (select doc_id, s i0, least(s + 2999, n_chars) i1 from (select doc_id, n_chars, unnest(range(1, n_chars + 1, 3000)) s from documents)) select g.doc_id, grp, i0 from groups g join r on g.doc_id = r.doc_id and grp_start <= i1 and grp_end >= i0")
def bed_overlap(spark, d):
    tiles = genome.tile_regions(_t(spark, d, "documents"), "doc_id", "n_chars").select("doc_id", F.col("chrst").alias("i0"), F.col("chrend").alias("i1"))
    return genome.overlap_join(_groups(spark, d), tiles, "doc_id", "grp_start", "grp_end", "i0", "i1", 2048).select("doc_id", "grp", "i0")


def _calls(spark, d) -> DataFrame:
    """Lines as calls: the read is the order, the group its part's brand's place, methylated by discount over tax."""
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("region_id"), F.col("l_orderkey").cast("string").alias("read_id"), F.col("l_linenumber").alias("grp"), F.col("l_discount").alias("log_m"), F.col("l_tax").alias("log_u"), "l_partkey")


_ONE = "(select cast(l_suppkey as varchar) region_id, cast(l_orderkey as varchar) read_id, l_linenumber grp, any_value(l_discount) log_m, any_value(l_tax) log_u from (select *, row_number() over (partition by l_suppkey, l_orderkey, l_linenumber order by l_partkey desc, l_discount desc, l_tax desc) rn from lineitem) where rn = 1 group by 1, 2, 3)"


def _last_calls(spark, d) -> DataFrame:
    g = _calls(spark, d).groupBy("region_id", "read_id", "grp").agg(F.max(F.struct("l_partkey", "log_m", "log_u")).alias("v"))
    return g.select("region_id", "read_id", "grp", "v.log_m", "v.log_u")


def _line_groups(spark, d) -> DataFrame:
    """Groups 1..7 of each supplier's region; a line is a call of the group that its number names."""
    return _calls(spark, d).select("region_id").distinct().select("region_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("grp")).withColumns({"first_pos": F.col("grp") * 10, "last_pos": F.col("grp") * 10 + 4})


@_query(f"select region_id, read_id, grp, log_m, log_u from {_ONE} where grp <= 6")
def calls_to_groups(spark, d):
    placed = _calls(spark, d).withColumns({"start": F.col("grp") * 10 - 1, "end": F.col("grp") * 10 + 3})
    return calls.calls_on_groups(placed.drop("grp").withColumn("last", F.struct("l_partkey", "log_m", "log_u")), _line_groups(spark, d).where("grp <= 6"), order="last")


@_query(f"select region_id, read_id, grp, case when log_m > log_u then 0.0 else -50.0 end::double log_m, case when log_m > log_u then -50.0 else 0.0 end::double log_u from {_ONE}")
def certain_calls(spark, d):
    placed = _calls(spark, d).withColumns({"start": F.col("grp") * 10 - 1, "end": F.col("grp") * 10 + 3})
    return calls.calls_on_groups(placed.drop("grp").withColumn("last", F.struct("l_partkey", "log_m", "log_u")), _line_groups(spark, d), order="last", certain=True)


@_query(f"with c as {_ONE} select region_id, round(sum(n) / 7.0, 6) as depth, round(count(*) / 7.0, 6) as perc_obs from (select region_id, grp, count(*) n from c group by 1, 2) group by 1 having sum(n) / 7.0 >= 10 and count(*) / 7.0 >= 0.66")
def coverage_filter(spark, d):
    c = _last_calls(spark, d)
    groups = c.select("region_id").distinct().select("region_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("grp"), F.lit(2).alias("n_cpg"))
    return calls.coverage_filter(c, groups).select("region_id", _r("depth").alias("depth"), _r("perc_obs").alias("perc_obs"))


@_query("select l_orderkey, l_linenumber, case when l_discount > l_tax then 0.0 else -50.0 end::double as log_m, case when l_discount > l_tax then -50.0 else 0.0 end::double as log_u, case when l_discount > l_tax then 1 else -1 end as sgn from lineitem")
def binarise_calls(spark, d):
    m, u = scalars.binarise(F.col("l_discount"), F.col("l_tax"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.alias("log_m"), u.alias("log_u"), scalars.call_sign(F.col("l_discount"), F.col("l_tax")).alias("sgn"))


@_query(f"select region_id, grp, round(avg(case when log_m > log_u then 1 else -1 end), 6) as ex from {_ONE} group by 1, 2")
def sample_ex(spark, d):
    return calls.sample_ex(_last_calls(spark, d)).select("region_id", "grp", _r("ex").alias("ex"))


#: Reads over the calls of one big region: nations, so that a read has several groups.
_WIDE = "(select cast(o_custkey % 20 as varchar) region_id, cast(l_orderkey as varchar) read_id, l_linenumber grp, max(l_discount) log_m, min(l_tax) log_u from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3)"


def _wide_calls(spark, d) -> DataFrame:
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy((F.col("o_custkey") % 20).cast("string").alias("region_id"), F.col("l_orderkey").cast("string").alias("read_id"), F.col("l_linenumber").alias("grp")).agg(F.max("l_discount").alias("log_m"), F.min("l_tax").alias("log_u"))


@_query(f"""with s as (select region_id, grp, case when log_m > log_u then 1 else -1 end s, lead(case when log_m > log_u then 1 else -1 end) over w s2, lead(grp) over w g2 from {_WIDE} window w as (partition by region_id, read_id order by grp))
select region_id, grp, round(avg(s * s2), 6) as exx from s where g2 = grp + 1 group by 1, 2""")
def sample_exx(spark, d):
    return calls.sample_exx(_wide_calls(spark, d)).select("region_id", "grp", _r("exx").alias("exx"))


@_query(f"""with c as {_WIDE}, x as (select region_id, grp, avg(case when log_m > log_u then 1.0 else -1.0 end)::double ex from c group by 1, 2),
s as (select region_id, grp, case when log_m > log_u then 1 else -1 end s, lead(case when log_m > log_u then 1 else -1 end) over w s2, lead(grp) over w g2 from c window w as (partition by region_id, read_id order by grp)),
y as (select region_id, grp, avg(s * s2) exx from s where g2 = grp + 1 group by 1, 2),
sites as (select region_id, g * 100 + k * 4 as pos, g grp from (select distinct region_id from c), range(1, 8) t(g), range(0, 3) u(k)),
n as (select *, lead(pos) over (partition by region_id order by pos) next_pos, lead(grp) over (partition by region_id order by pos) ng from sites)
select n.region_id, n.pos, n.next_pos, round(ex, 6) as ex, round(case when ng = n.grp then case when ex is not null then 1.0 end when ng = n.grp + 1 then exx end, 6) as exx from n left join x on x.region_id = n.region_id and x.grp = n.grp left join y on y.region_id = n.region_id and y.grp = n.grp""")
def site_averages(spark, d):
    c = _wide_calls(spark, d)
    site = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda g: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((g * 100 + k * 4).cast("long").alias("pos"), g.alias("grp")))))).alias("s")
    sites = c.select("region_id").distinct().select("region_id", site).select("region_id", "s.pos", "s.grp")
    return calls.site_averages(sites, calls.sample_ex(c), calls.sample_exx(c)).select("region_id", "pos", "next_pos", _r("ex").alias("ex"), _r("exx").alias("exx"))


@_query(f"select region_id, grp, round(avg(case when log_m - log_u >= 0 then 1.0 else 0.0 end), 6) as p from {_ONE} group by 1, 2")
def marginal_p(spark, d):
    return calls.marginal_model(_last_calls(spark, d)).select("region_id", "grp", _r("p").alias("p"))


@_query(f"""with p as (select region_id, grp, avg(case when log_m - log_u >= 0 then 1.0 else 0.0 end)::double p from {_ONE} group by 1, 2)
select region_id, round(avg(p), 6) as mml, round(avg(-(p * log2(greatest(p, 2.220446049250313e-16)) + (1 - p) * log2(greatest(1 - p, 2.220446049250313e-16)))), 6) as nme from p group by 1""")
def marginal_levels(spark, d):
    p = calls.marginal_model(_last_calls(spark, d))
    return calls.marginal_summaries(p, ["region_id"]).select("region_id", _r("mml").alias("mml"), _r(F.col("nme") + 0.0).alias("nme"))


@_query("with e as (select l_partkey, avg(case when l_discount > l_tax then 1.0 else -1.0 end)::double ex from lineitem group by 1) select l_partkey, round(case when ex >= 1 then 20 when ex <= -1 then -20 else least(greatest(0.5 * ln((1 + ex) / (1 - ex)), -20), 20) end, 6) as alpha from e")
def alpha_from_ex(spark, d):
    e = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg(scalars.call_sign(F.col("l_discount"), F.col("l_tax")).cast("double")).alias("ex"))
    return e.select("l_partkey", _r(scalars.alpha_from_ex(F.col("ex"))).alias("alpha"))


_GROUPED = "(select l_partkey, case when s_nationkey < 12 then 1 else 2 end grp from lineitem join supplier on s_suppkey = l_suppkey)"


def _grouped(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", F.when(F.col("s_nationkey") < 12, 1).otherwise(2).alias("grp"))


@_query(f"select l_partkey from {_GROUPED} group by 1 having count(*) filter (grp = 1) > 0 and count(*) filter (grp = 2) > 0")
def common_regions(spark, d):
    return comparison.common_keys(_grouped(spark, d), ["l_partkey"])


#: Nations are dealt to two groups of 8 replicates, so that all customers count.
_BAL = "(select c_mktsegment seg, c_nationkey % 8 i, avg(case when c_nationkey // 8 % 2 = 0 then c_acctbal end) - avg(case when c_nationkey // 8 % 2 = 1 then c_acctbal end) x from customer group by 1, 2)"


@_query(f"""with v as {_BAL}, m as (select seg, avg(x) stat, count(*) n from v group by 1), j as (select unnest(range(0, 256)) j),
t as (select seg, j, sum(case when (j >> i) & 1 = 1 then x else -x end) / 8 t from v, j group by 1, 2)
select t.seg, round(any_value(stat), 4) as stat, round(count(*) filter (abs(t) >= abs(stat) - 1e-9) / 256.0, 6) as p from t join m on m.seg = t.seg group by 1""")
def tmml_matched(spark, d):
    first = F.floor(F.col("c_nationkey") / 8) % 2 == 0
    x = F.avg(F.when(first, F.col("c_acctbal"))) - F.avg(F.when(~first, F.col("c_acctbal")))
    v = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 8).alias("i")).agg(x.alias("x"))
    return comparison.matched_test(v, ["seg"]).select("seg", _r("stat", 4).alias("stat"), _r("p").alias("p"))


_REP = "(select c_mktsegment seg, c_nationkey % 8 i, case when c_nationkey % 8 < 4 then 1 else 2 end grp, avg(c_acctbal) x from customer group by 1, 2, 3)"


@_query(f"""with v as {_REP}, o as (select seg, avg(x) filter (grp = 1) - avg(x) filter (grp = 2) stat from v group by 1),
m as (select j from (select unnest(range(0, 256)) j) where bit_count(j) = 4),
t as (select seg, j, sum(case when (j >> i) & 1 = 1 then x else 0 end) / 4 - sum(case when (j >> i) & 1 = 1 then 0 else x end) / 4 t from v, m group by 1, 2)
select t.seg, round(any_value(stat), 4) as stat, round(count(*) filter (abs(t) >= abs(stat) - 1e-9) / 70.0, 6) as p from t join o on o.seg = t.seg group by 1""")
def tmml_unmatched(spark, d):
    i = F.col("c_nationkey") % 8
    v = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg"), i.alias("i"), F.when(i < 4, 1).otherwise(2).alias("grp")).agg(F.avg("c_acctbal").alias("x"))
    return comparison.unmatched_test(v, ["seg"]).select("seg", _r("stat", 4).alias("stat"), _r("p").alias("p"))


def _chains(spark, d) -> DataFrame:
    """A chain per nation over all its suppliers: fields from their balances, one coupling."""
    s = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", (F.col("s_acctbal") / 10000.0).alias("a")))).alias("v"))
    s = s.select("s_nationkey", F.transform("v", lambda x: x.a).alias("alpha")).where(F.size("alpha") >= 2)
    return s.withColumn("beta", F.array_repeat(F.lit(0.25), F.size("alpha") - 1))


def _chain_sql(name: str, source: str) -> str:
    """CTEs of forward and backward messages (own field in, out) of chains (id, i from 1, a, n)."""
    lse = lambda x, y: f"greatest({x}, {y}) + ln(1 + exp(-abs(({x}) - ({y}))))"
    return f""", {name} as ({source}),
{name}_f as (select id, i, n, a p, -a m from {name} where i = 1 union all
 select c.id, c.i, c.n, c.a + {lse("f.p + 0.25", "f.m - 0.25")}, -c.a + {lse("f.p - 0.25", "f.m + 0.25")} from {name}_f f join {name} c on c.id = f.id and c.i = f.i + 1),
{name}_b as (select id, i, n, 0::double p, 0::double m from {name} where i = n union all
 select c.id, c.i - 1, c.n, {lse("0.25 + c.a + b.p", "-0.25 - c.a + b.m")}, {lse("-0.25 + c.a + b.p", "0.25 - c.a + b.m")} from {name}_b b join {name} c on c.id = b.id and c.i = b.i where b.i > 1),
{name}_z as (select id, n, {lse("p", "m")} z from {name}_f where i = n)"""


def _moments_sql(name: str) -> str:
    """CTE of E[X] and E[XX] of each place of the chains of ``_chain_sql``."""
    pair = " + ".join(f"({s * t}) * exp(f.{'p' if s > 0 else 'm'} + ({0.25 * s * t}) + ({t}) * c.a + b2.{'p' if t > 0 else 'm'} - z)" for s in (1, -1) for t in (1, -1))
    return f""", {name}_e as (select f.id, f.i, f.n, exp(f.p + b.p - z) - exp(f.m + b.m - z) ex, {pair} exx from {name}_f f join {name}_z z on z.id = f.id join {name}_b b on b.id = f.id and b.i = f.i
 left join {name} c on c.id = f.id and c.i = f.i + 1 left join {name}_b b2 on b2.id = f.id and b2.i = f.i + 1)"""


_ONE_CHAIN = """select s_nationkey id, row_number() over (partition by s_nationkey order by s_suppkey) i, s_acctbal / 10000.0 a, count(*) over (partition by s_nationkey) n from supplier"""
_LOGZ = "with recursive nothing as (select 1)" + _chain_sql("c", f"select * from ({_ONE_CHAIN}) where n >= 2")
_MOMENTS = _LOGZ + _moments_sql("c")
_ENERGY = "(select c.id, sum(c.a * ex) + 0.25 * sum(coalesce(exx, 0)) u from c join c_e e on e.id = c.id and e.i = c.i group by 1)"


@_query(_LOGZ + " select id as s_nationkey, round(z, 6) as log_z from c_z")
def ising_logz(spark, d):
    return _chains(spark, d).select("s_nationkey", _r(scalars.ising_log_z(F.col("alpha"), F.col("beta"))).alias("log_z"))


def _summaries(spark, d) -> DataFrame:
    from strandloom.operators import models
    from strandloom.session import ship

    ship(spark)
    c = _chains(spark, d).withColumns({"region_id": F.col("s_nationkey").cast("string"), "p": F.array(F.lit(0)), "q": F.array(F.size("alpha") - 1)})
    return models.summaries(c, ("region_id",))


@_query(_MOMENTS + " select cast(id as varchar) as region_id, cast(i - 1 as int) as n, round(ex, 6) as ex from c_e")
def ising_ex(spark, d):
    return _summaries(spark, d).select("region_id", F.posexplode("ex").alias("n", "ex")).select("region_id", "n", _r("ex").alias("ex"))


@_query(_MOMENTS + " select cast(id as varchar) as region_id, cast(i - 1 as int) as n, round(exx, 6) as exx from c_e where exx is not null")
def ising_exx(spark, d):
    return _summaries(spark, d).select("region_id", F.posexplode("exx").alias("n", "exx")).select("region_id", "n", _r("exx").alias("exx"))


@_query(_MOMENTS + f" select cast(z.id as varchar) as region_id, round((z - u) / (n * ln(2)), 6) as nme from c_z z join {_ENERGY} u on u.id = z.id")
def ising_nme(spark, d):
    return _summaries(spark, d).select("region_id", _r(F.col("nme")[0]).alias("nme"))


#: Pairs of nations with as many suppliers; a mixture's chain has the id first * 1000 + second.
_MIX = "select x.id * 1000 + y.id id, x.i, (x.a + y.a) / 2 a, x.n, x.id x, y.id y from c x join c y on x.n = y.n and x.i = y.i and x.id < y.id"


@_query(_MOMENTS + _chain_sql("m", _MIX) + f""", u as {_ENERGY},
cross_ as (select m.id, sum(m.a * (ex.ex + ey.ex)) + 0.25 * sum(coalesce(ex.exx, 0) + coalesce(ey.exx, 0)) u from m join c_e ex on ex.id = m.x and ex.i = m.i join c_e ey on ey.id = m.y and ey.i = m.i group by 1)
select cast(m.x as int) as i, cast(m.y as int) as j, round(1 - (zx.z - ux.u + zy.z - uy.u) / (2 * mz.z - k.u), 6) as cmd from m join m_z mz on mz.id = m.id join cross_ k on k.id = m.id join c_z zx on zx.id = m.x join c_z zy on zy.id = m.y
join u ux on ux.id = m.x join u uy on uy.id = m.y where m.i = 1""")
def cmd_pairs(spark, d):
    from strandloom.operators import models
    from strandloom.session import ship

    ship(spark)
    c = _chains(spark, d).select(F.size("alpha").cast("string").alias("region_id"), F.col("s_nationkey").alias("sample"), "alpha", "beta", F.array(F.lit(0)).alias("p"), F.array(F.size("alpha") - 1).alias("q"))
    return models.divergences(models.model_pairs(c)).select("i", "j", _r("cmd").alias("cmd"))


@_query("""with p as (select o_orderkey, o_orderpriority g, round(o_totalprice / 1000000.0, 3) p from orders),
r as (select *, rank() over (partition by g order by p) + count(*) over (partition by g, p) - 1 r, count(*) over (partition by g) m from p)
select o_orderkey, g, p, round(least(1.0, min(p * m / r) over (partition by g order by p desc range between unbounded preceding and current row)), 6) as q from r""")
def bh_qvalues(spark, d):
    p = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), _r(F.col("o_totalprice") / 1000000.0, 3).alias("p"))
    return comparison.bh(p, ["g"]).select("o_orderkey", "g", "p", _r("q").alias("q"))


@_query("""with r as (select distinct cast(l_orderkey as varchar) read_id from lineitem), o as (select read_id, row_number() over (order by md5('0:' || read_id), read_id) - 1 rk, count(*) over () n from r),
b as (select read_id, case when rk < n // 8 + n % 8 then 0 else 1 + (rk - n // 8 - n % 8) // (n // 8) end bucket from o)
select cast(bucket as int) as bucket, count(distinct b.read_id) as reads, count(*) as rows from b join lineitem on cast(l_orderkey as varchar) = read_id group by 1""")
def split_reads(spark, d):
    from strandloom.sources import writers

    return writers.split_reads(_calls(spark, d), 8).groupBy("bucket").agg(F.countDistinct("read_id").alias("reads"), F.count(F.lit(1)).alias("rows"))


@_query("""with raw as (select r_name || p_brand kmer, avg(p_retailprice) mean, p_size sd from part join region on p_size % 5 = r_regionkey group by 1, 3),
u as (select kmer, sd sd_u, mean mean_u from raw where kmer not like '%M%' and kmer like '%C%'), m as (select replace(kmer, 'M', 'C') kmer, sd sd_m, mean mean_m from raw where kmer like '%M%')
select coalesce(u.kmer, m.kmer) as kmer, round(mean_u, 4) as mean_u, sd_u, round(mean_m, 4) as mean_m, sd_m from u full join m on u.kmer = m.kmer""")
def pore_merge(spark, d):
    from strandloom.sources import readers

    raw = _t(spark, d, "part").join(_t(spark, d, "region"), F.col("p_size") % 5 == F.col("r_regionkey")).groupBy(F.concat("r_name", "p_brand").alias("kmer"), F.col("p_size").alias("sd")).agg(F.avg("p_retailprice").alias("mean"))
    return readers.merge_pore_model(raw).select("kmer", _r("mean_u", 4).alias("mean_u"), "sd_u", _r("mean_m", 4).alias("mean_m"), "sd_m")


@_query("select conv_id as qname, min(turn) as first, max(turn) as last from conversations group by 1 having count(*) = 2")
def mates(spark, d):
    r = _t(spark, d, "conversations").select(F.col("conv_id").alias("qname"), F.col("turn").alias("pos"), F.lit(0).alias("flag"), F.col("text").alias("xm"))
    return calls.mate_pairs(r).select("qname", F.col("r1.pos").alias("first"), F.col("r2.pos").alias("last"))


#: Flags of single ends and of both mates, by lines.
_FLAGS = ((0, None, False), (16, None, False), (99, 147, True), (83, 163, True), (147, 99, True), (163, 83, True))


@_query("select l_orderkey, l_linenumber, ['OT', 'OB', 'OT', 'OB', 'CTOT', 'CTOB'][l_partkey % 6 + 1] as strand from lineitem")
def strand_case(spark, d):
    k = (F.col("l_partkey") % 6).cast("int")
    at = lambda i: F.get(F.array(*[F.lit(x[i]).cast("int" if i < 2 else "boolean") for x in _FLAGS]), k)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.strand(at(2), at(0), at(1)).alias("strand"))


@_query("select doc_id, md5(replace(text, 'an', 'aM')) as marked, len(string_split(text, 'an')) - 1 as n from documents")
def meth_string(spark, d):
    n = F.size(F.split("text", "an", -1)) - 1
    marked = scalars.meth_seq(F.col("text"), F.array_repeat(F.lit(1), n), "an", "aM")
    return _t(spark, d, "documents").select("doc_id", F.md5(F.encode(marked, "UTF-8")).alias("marked"), n.cast("long").alias("n"))


_SCORED = "(select toxic = 1 as t, quality = 1 as g, n_chars / 10000.0 as s from labels join documents using (doc_id))"
_TH = [round(i / 20, 2) for i in range(21)]


def _scored(spark, d) -> DataFrame:
    j = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    return j.select((F.col("toxic") == 1).alias("t"), (F.col("quality") == 1).alias("g"), (F.col("n_chars") / 10000.0).alias("s"))


_POINTS = f"(select x as threshold, count(*) filter (t and s >= x) tp, count(*) filter (not t and s >= x) fp, count(*) filter (t) p, count(*) filter (not t) n from {_SCORED}, (select unnest({_TH})::double x) group by 1)"


@_query(f"select threshold, round(tp / p, 6) as tpr, round(fp / n, 6) as fpr from {_POINTS}")
def roc_points(spark, d):
    return evaluation.roc(_scored(spark, d), F.col("t"), F.col("s"), _TH).select("threshold", _r("tpr").alias("tpr"), _r("fpr").alias("fpr"))


@_query(f"with r as (select tp / p tpr, fp / n fpr from {_POINTS}) select round(sum((nx - fpr) * tpr), 6) as auc from (select *, lead(fpr) over (order by fpr, tpr) nx from r)")
def auc(spark, d):
    return evaluation.auc(evaluation.roc(_scored(spark, d), F.col("t"), F.col("s"), _TH)).select(_r("auc").alias("auc"))


@_query(f"select threshold, round(tp / (tp + fp), 3) as precision, round(tp / p, 3) as recall from {_POINTS} where tp + fp > 0 and p > 0")
def pr_curve(spark, d):
    return evaluation.precision_recall(_scored(spark, d), F.col("t"), F.col("s"), _TH)


@_query(f"""with c as (select count(*) filter (t and not g) tp, count(*) filter (not t and not g) fp, count(*) filter (not t and g) tn, count(*) filter (t and g) fn from {_SCORED})
select tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as sensitivity, round(tn / (tn + fp), 6) as specificity from c""")
def caller_metrics(spark, d):
    m = evaluation.confusion(_scored(spark, d), F.col("t"), ~F.col("g"))
    return m.select("tp", "fp", "tn", "fn", *[_r(c).alias(c) for c in ("accuracy", "precision", "sensitivity", "specificity")])


@_query(f"select x as threshold, round(count(*) filter (s >= x) / count(*), 6) as share, round(case when count(*) filter (s >= x) = 0 then 1 else count(*) filter (s >= x and t) / count(*) filter (s >= x) end, 6) as accuracy from {_SCORED}, (select unnest({_TH})::double x) group by 1")
def lrt_share(spark, d):
    return evaluation.share_above(_scored(spark, d), F.col("s"), F.col("t"), _TH).select("threshold", _r("share").alias("share"), _r("accuracy").alias("accuracy"))


_TUPLES = "(select l_orderkey k, l_linenumber o, l_partkey o2, l_discount - l_tax lr, case when l_discount > l_tax then 1 else -1 end c, case when l_quantity > 25 then 1 else -1 end t from lineitem)"


def _tuples(spark, d) -> DataFrame:
    """Calls with a ratio, what was called, and a truth, in order within an order."""
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("o2"), (F.col("l_discount") - F.col("l_tax")).alias("lr"), scalars.call_sign(F.col("l_discount"), F.col("l_tax")).alias("c"), F.when(F.col("l_quantity") > 25, 1).otherwise(-1).alias("t"))


_PAIRS = f"(select round(least(abs(lr), abs(lr2)), 6) ratio, t * t2 truth, c * c2 call from (select *, lead(lr) over w lr2, lead(t) over w t2, lead(c) over w c2 from {_TUPLES} window w as (partition by k order by o, o2, lr)) where lr2 is not null)"
_RATIOS = [round(i / 200 + 0.0025, 4) for i in range(20)]


@_query(f"select x as threshold, round(count(*) filter (ratio >= x) / count(*), 6) as share, round(case when count(*) filter (ratio >= x) = 0 then 1 else count(*) filter (ratio >= x and truth = call) / count(*) filter (ratio >= x) end, 6) as accuracy from {_PAIRS}, (select unnest({_RATIOS})::double x) group by 1")
def lrt_share_pairs(spark, d):
    p = evaluation.adjacent_pairs(_tuples(spark, d), ["k"], ["o", "o2", "lr"], F.col("lr"), F.col("t"), F.col("c"))
    return evaluation.share_above(p, F.round("ratio", 6), F.col("truth") == F.col("call"), _RATIOS).select("threshold", _r("share").alias("share"), _r("accuracy").alias("accuracy"))


@_query(f"select truth, call, count(*) as n from {_PAIRS} group by 1, 2")
def adjacent_products(spark, d):
    p = evaluation.adjacent_pairs(_tuples(spark, d), ["k"], ["o", "o2", "lr"], F.col("lr"), F.col("t"), F.col("c"))
    return p.groupBy("truth", "call").agg(F.count(F.lit(1)).alias("n"))


@_query("select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 0 when l_discount >= 0.05 then 1 else -1 end as call from lineitem")
def thresholded_calls(spark, d):
    score = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", evaluation.call_at(score, 0.05).alias("call"))


@_query(f"""with b as (select cast(floor(s * 10) as bigint) bin, count(*) n, count(*) filter (t) k from {_SCORED} group by 1)
select bin, n, round(n / sum(n) over (), 6) as share, round(k / n, 6) as accuracy, cast(sum(n) over (order by bin) as bigint) as upto, round(sum(k) over (order by bin) / sum(n) over (order by bin), 6) as running from b""")
def lrt_interval(spark, d):
    b = evaluation.accuracy_by_interval(_scored(spark, d), F.col("s"), F.col("t"), 0.0, per=10)
    return b.select("bin", "n", _r("share").alias("share"), _r("accuracy").alias("accuracy"), "upto", _r("running").alias("running"))


@_query(f"""with b as (select cast(floor((lr + 0.005) / 0.01) as bigint) bin, count(*) n, count(*) filter (c = t) k from {_TUPLES} group by 1), s as (select bin, n / sum(n) over () share, k / n accuracy from b),
f as (select r far, coalesce(sum(share), 0) share, (coalesce(sum(accuracy), 0) + case when r = 0 then 1 else 2 end - count(bin)) / case when r = 0 then 1 else 2 end accuracy from range(0, 9) t(r) left join s on abs(bin) = r group by r),
g as (select 8 - far step, far, accuracy, sum(share) over (order by far desc) share from f)
select cast(step as int) as step, round(share, 6) as share, round(sum(accuracy * share) over (order by far desc) / sum(share) over (order by far desc), 6) as accuracy from g""")
def accuracy_curve(spark, d):
    b = evaluation.accuracy_by_interval(_tuples(spark, d), F.col("lr"), F.col("c") == F.col("t"), -0.005, 0.01)
    return evaluation.accuracy_curve(b, 8).select("step", _r("share").alias("share"), _r("accuracy").alias("accuracy"))


@_query(f"select x as threshold, round(avg(case when s <= x then 1.0 else 0.0 end), 6) as share from {_SCORED}, (select unnest({_TH})::double x) group by 1")
def ecdf(spark, d):
    return evaluation.ecdf(_scored(spark, d), F.col("s"), _TH).select("threshold", _r("share").alias("share"))


@_query("with b as (select cast(floor(l_extendedprice / 5000.0) as bigint) bin, count(*) n from lineitem group by 1) select bin, n, round(n / sum(n) over (), 6) as share from b")
def hist1d(spark, d):
    return evaluation.histogram1d(_t(spark, d, "lineitem"), F.col("l_extendedprice"), 0.0, 5000.0).select("bin", "n", _r("share").alias("share"))


@_query("""with c as (select cast(least(greatest(floor(l_discount * 8), 0), 7) as int) bx, cast(least(greatest(floor(l_tax * 8), 0), 7) as int) as by_, count(*) n from lineitem group by 1, 2),
g as (select cast(i // 8 as int) bx, cast(i % 8 as int) by_ from range(64) t(i)), f as (select g.bx, g.by_, coalesce(n, 0) + 1 n from g left join c on c.bx = g.bx and c.by_ = g.by_)
select bx, by_ as "by", round(-log10(n / sum(n) over ()), 6) as v from f""")
def hist2d_log(spark, d):
    return evaluation.histogram2d_log(_t(spark, d, "lineitem"), F.col("l_discount"), F.col("l_tax"), 8).select("bx", "by", _r("v").alias("v"))


@_query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.75), 4) as q3, count(*) as n from orders group by 1")
def median_stats(spark, d):
    b = evaluation.box_statistics(_t(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice"))
    return b.select("o_orderpriority", *[_r(c, 4).alias(c) for c in ("q1", "median", "q3")], "n")


@_query("select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1")
def corr_pairs(spark, d):
    return evaluation.pearson(_t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice")).select("l_returnflag", _r("r").alias("r"))


@_query("""with e as (select vec_id, embedding::double[] v, lag(embedding::double[]) over (partition by label order by vec_id) w, label from embeddings)
select vec_id, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 6) as cosine from e where w is not null""")
def cosine_pairs(spark, d):
    e = _t(spark, d, "embeddings").withColumn("w", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id")))
    return e.where("w is not null").select("vec_id", _r(scalars.cosine(F.col("embedding"), F.col("w"))).alias("cosine"))


@_query("select l_returnflag, round(avg(abs(l_discount - l_tax)), 6) as mae, round(avg((l_discount - l_tax) ** 2), 6) as mse from lineitem group by 1")
def mae_mse(spark, d):
    return evaluation.errors(_t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount"), F.col("l_tax")).select("l_returnflag", _r("mae").alias("mae"), _r("mse").alias("mse"))


@_query("with a as (select avg(n_chars)::double theta, count(*) n from documents) select round(theta, 6) as theta, n, round(-n * (ln(theta) + 1), 4) as log_lik, round(2 + 2 * n * (ln(theta) + 1), 4) as aic from a")
def exp_mle(spark, d):
    return evaluation.exponential_fit(_t(spark, d, "documents"), F.col("n_chars")).select(_r("theta").alias("theta"), "n", _r("log_lik", 4).alias("log_lik"), _r("aic", 4).alias("aic"))


@_query("select o_custkey as read_id from orders group by 1 having count(*) >= 1")
def dedup_unique(spark, d):
    return calls.region_reads(_t(spark, d, "orders").select(F.lit("r").alias("region_id"), F.col("o_custkey").alias("read_id"))).select("read_id")


#: Parts and the groups of nations whose suppliers sell them.
_SOLD = "(select l_partkey, case when s_nationkey < 12 then 1 else 2 end s from lineitem join supplier on s_suppkey = l_suppkey)"


@_query(f"select distinct l_partkey, s from {_SOLD} x where not exists (select 1 from {_SOLD} y where y.l_partkey = x.l_partkey and y.s <> x.s)")
def set_complement(spark, d):
    grouped = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", F.when(F.col("s_nationkey") < 12, 1).otherwise(2).alias("grp"))
    return comparison.exclusive_keys(grouped, ["l_partkey"]).select("l_partkey", F.col("grp").alias("s"))


@_query("select l_suppkey as k, count(*) as n from lineitem where l_discount > 0.05 and l_suppkey in (select l_suppkey from lineitem where l_tax > 0.07) group by 1")
def set_intersection(spark, d):
    line = _t(spark, d, "lineitem")
    one = line.where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return evaluation.paired_estimates(one, line.where("l_tax > 0.07").select(F.col("l_suppkey").alias("k"), F.lit(1).alias("n")).distinct(), ["k"], "n").select("k", F.col("x").alias("n"))


def queries() -> dict[str, Query]:
    from strandloom.plans import catalog_files, catalog_models  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(ORACLES)
