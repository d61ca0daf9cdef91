"""Queries over models, regions, tests and evaluation, with SQL that gets there in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import scalars
from strandloom.operators import comparison, evaluation, genome, models, simulation
from strandloom.plans.catalog import _ENERGY, _LOGZ, _MIX, _MOMENTS, _POINTS, _SCORED, _TH, _chain_sql, _chains, _scored
from strandloom.plans.registry import query, rounded, table
from strandloom.session import ship

# --- chains: each nation's suppliers


def _by_region(spark, d) -> DataFrame:
    ship(spark)
    return _chains(spark, d).withColumn("region_id", F.col("s_nationkey").cast("string"))


def _moments(spark, d) -> DataFrame:
    return models.moments(_by_region(spark, d))


@query(_MOMENTS + " select cast(id as varchar) as region_id, cast(i - 1 as int) as n, round(0.5 * (ex + 1), 6) as px from c_e")
def site_marginals(spark, d):
    return _moments(spark, d).select("region_id", F.posexplode("px").alias("n", "px")).select("region_id", "n", rounded("px").alias("px"))


@query(_MOMENTS + """ , n as (select id, i, ex, exx, lead(ex) over (partition by id order by i) nx from c_e)
select cast(id as varchar) as region_id, cast(i - 1 as int) as n, round((exx - ex * nx) / (sqrt(1 - ex * ex) * sqrt(1 - nx * nx)), 5) as corr from n where nx is not null""")
def neighbour_correlations(spark, d):
    return _moments(spark, d).select("region_id", F.posexplode("corr").alias("n", "corr")).select("region_id", "n", rounded("corr", 5).alias("corr"))


@query(_MOMENTS + """ , n as (select id, i, ex, exx, lead(ex) over (partition by id order by i) nx from c_e)
select cast(id as varchar) as region_id, cast(i - 1 as int) as n, round((exx - ex * nx) / sqrt((1 - ex * ex) * (1 - nx * nx)), 5) as corr, round(least(1, greatest(0, 0.25 * (exx + ex + nx + 1))), 6) as eyy from n where nx is not null""")
def neighbour_products(spark, d):
    s = _moments(spark, d).select("region_id", F.posexplode(F.arrays_zip("ex", "exx")).alias("pos", "v")).select("region_id", "pos", "v.ex", "v.exx")
    from pyspark.sql import Window as W

    nxt = F.lead("ex").over(W.partitionBy("region_id").orderBy("pos"))
    s = s.withColumn("nx", nxt).where("nx is not null")
    return s.select("region_id", F.col("pos").alias("n"), rounded(scalars.site_correlation(F.col("ex"), F.col("nx"), F.col("exx")), 5).alias("corr"), rounded(scalars.product_moment(F.col("ex"), F.col("nx"), F.col("exx"))).alias("eyy"))


@query(_MOMENTS + """ , n as (select id, i, ex, exx, lead(ex) over (partition by id order by i) nx from c_e)
select cast(id as varchar) as region_id, cast(i - 1 as int) as pos, round(least(1, greatest(0, 0.25 * (exx + ex + nx + 1))), 6) as eyy from n where nx is not null""")
def yy_moments(spark, d):
    from strandloom.plans import pipelines

    s = _moments(spark, d).select("region_id", F.posexplode(F.arrays_zip("ex", "exx")).alias("pos", "v")).select("region_id", "pos", "v.ex", "v.exx")
    return pipelines.yy_moments(s).select("region_id", "pos", rounded("eyy").alias("eyy"))


#: All states of each chain of up to 10 sites, with their probabilities.
_STATES = f"""with recursive x as (select * from (select s_nationkey id, row_number() over (partition by s_nationkey order by s_suppkey) i, s_acctbal / 10000.0 a, count(*) over (partition by s_nationkey) n from supplier) where n between 2 and 10),
st as (select id, n, unnest(range(0, cast(pow(2, n) as int))) j from (select distinct id, n from x)),
v as (select st.id, j, st.n, i, a, case when (j >> (i - 1)::int) & 1 = 1 then 1 else -1 end s from st join x on x.id = st.id),
e as (select id, j, exp(sum(a * s) + 0.25 * sum(s * nx)) w from (select *, coalesce(lead(s) over (partition by id, j order by i), 0) nx from v) group by 1, 2),
z as (select id, sum(w) z from e group by 1), pr as (select e.id, j, w / z p from e join z on z.id = e.id)"""


@query(_STATES + """, m as (select v.id, i, sum(p * s) ex from v join pr on pr.id = v.id and pr.j = v.j group by 1, 2),
two as (select a.id, a.i i, b.i k, sum(p * a.s * b.s) m from v a join v b on a.id = b.id and a.j = b.j and a.i < b.i join pr on pr.id = a.id and pr.j = a.j group by 1, 2, 3)
select cast(id as varchar) as region_id, cast(i - 1 as int) as i, cast(k - 1 as int) as j, round(m, 6) as m from two union all select cast(id as varchar), cast(i - 1 as int), cast(i - 1 as int), round(1 - ex * ex, 6) from m""")
def second_moments(spark, d):
    few = _by_region(spark, d).where(F.size("alpha") <= 10)  # as many as the SQL can enumerate
    rows = models.moments(few, second=True).select("region_id", F.posexplode("second").alias("i", "row")).select("region_id", "i", F.posexplode("row").alias("j", "m"))
    return rows.where("j >= i").select("region_id", "i", "j", rounded("m").alias("m"))


@query(_MOMENTS + f""", u as {_ENERGY}, cross_ as (select x.id x, y.id y, sum(y.a * ex.ex) + 0.25 * sum(coalesce(ex.exx, 0)) k from c x join c y on x.n = y.n and x.i = y.i and x.id < y.id join c_e ex on ex.id = x.id and ex.i = x.i group by 1, 2)
select cast(x as int) as i, cast(y as int) as j, round(zy.z - k - (zx.z - u.u), 6) as kl from cross_ join c_z zx on zx.id = x join c_z zy on zy.id = y join u on u.id = x""")
def kl_pairs(spark, d):
    ship(spark)
    c = _chains(spark, d).select(F.size("alpha").cast("string").alias("region_id"), F.col("s_nationkey").alias("sample"), "alpha", "beta", F.array(F.lit(0)).alias("p"), F.array(F.size("alpha") - 1).alias("q"))
    return models.whole_divergences(models.model_pairs(c)).select("i", "j", rounded("kl").alias("kl"))


@query(_MOMENTS + _chain_sql("m", _MIX) + f""", u as {_ENERGY},
cross_ as (select m.id, sum(m.a * (ex.ex + ey.ex)) + 0.25 * sum(coalesce(ex.exx, 0) + coalesce(ey.exx, 0)) u from m join c_e ex on ex.id = m.x and ex.i = m.i join c_e ey on ey.id = m.y and ey.i = m.i group by 1)
select cast(m.x as int) as i, cast(m.y as int) as j, round(least(1, greatest(0, 1 - (zx.z - ux.u + zy.z - uy.u) / (2 * mz.z - k.u))), 6) as cmd from m join m_z mz on mz.id = m.id join cross_ k on k.id = m.id join c_z zx on zx.id = m.x join c_z zy on zy.id = m.y
join u ux on ux.id = m.x join u uy on uy.id = m.y where m.i = 1""")
def whole_cmd(spark, d):
    ship(spark)
    c = _chains(spark, d).select(F.size("alpha").cast("string").alias("region_id"), F.col("s_nationkey").alias("sample"), "alpha", "beta", F.array(F.lit(0)).alias("p"), F.array(F.size("alpha") - 1).alias("q"))
    return models.whole_divergences(models.model_pairs(c)).select("i", "j", rounded("cmd").alias("cmd"))


#: Pieces of a chain: its first third, and the rest.
_CUT = "(select id, n, greatest(n // 3, 1) cut from c_z)"
_PIECES = f"(select id, 0 k, 1 p, cut q from {_CUT} union all select id, 1, cut + 1, n from {_CUT} where cut < n)"


def _in_pieces(spark, d) -> DataFrame:
    cut = F.greatest(F.floor(F.size("alpha") / 3), F.lit(1)).cast("int")
    return _by_region(spark, d).withColumns({"p": F.array(F.lit(0), cut), "q": F.array(cut - 1, F.size("alpha") - 1)})


@query(_MOMENTS + f"""select cast(w.id as varchar) as region_id, cast(w.k as int) as k, round(0.5 * (1 + avg(ex)), 6) as mml from {_PIECES} w join c_e e on e.id = w.id and e.i between w.p and w.q group by 1, 2""".replace("select cast", " select cast", 1))
def piece_mml(spark, d):
    s = models.summaries(_in_pieces(spark, d), ("region_id",)).select("region_id", F.posexplode("mml").alias("k", "mml"))
    return s.select("region_id", "k", rounded("mml").alias("mml"))


#: Of each piece: what its marginal leaves out (the messages into both ends), and its energy.
_EDGES = f"""(select w.id, w.k, w.p, w.q,
 (1 + ep.ex) / 2 * (fp.p - cp.a) + (1 - ep.ex) / 2 * (fp.m + cp.a) + (1 + eq.ex) / 2 * bq.p + (1 - eq.ex) / 2 * bq.m ends,
 (select sum(c.a * e.ex) from c join c_e e on e.id = c.id and e.i = c.i where c.id = w.id and c.i between w.p and w.q) + 0.25 * coalesce((select sum(e.exx) from c_e e where e.id = w.id and e.i >= w.p and e.i < w.q), 0) u
 from {_PIECES} w join c_e ep on ep.id = w.id and ep.i = w.p join c_f fp on fp.id = w.id and fp.i = w.p join c cp on cp.id = w.id and cp.i = w.p join c_e eq on eq.id = w.id and eq.i = w.q join c_b bq on bq.id = w.id and bq.i = w.q)"""


@query(_MOMENTS + f" select cast(w.id as varchar) as region_id, cast(k as int) as k, round((z - ends - u) / ((q - p + 1) * ln(2)), 6) as nme from {_EDGES} w join c_z z on z.id = w.id")
def piece_nme(spark, d):
    s = models.summaries(_in_pieces(spark, d), ("region_id",)).select("region_id", F.posexplode("nme").alias("k", "nme"))
    return s.select("region_id", "k", rounded("nme").alias("nme"))


#: Means of pairs of chains, cut as their parts are; what each part sees of the mean's marginal.
_MIXED = _MOMENTS + _chain_sql("m", _MIX) + f""", cuts as {_PIECES}, one as {_EDGES}, pair as (select distinct id mid, x, y from m), side as (select mid, x, y, x s from pair union all select mid, x, y, y from pair),
seen as (select s.mid, s.x, s.y, w.k, w.p, w.q, mz.z
 - ((1 + ep.ex) / 2 * (fp.p - cp.a) + (1 - ep.ex) / 2 * (fp.m + cp.a) + (1 + eq.ex) / 2 * bq.p + (1 - eq.ex) / 2 * bq.m)
 - (select sum(m.a * e.ex) from m join c_e e on e.id = s.s and e.i = m.i where m.id = s.mid and m.i between w.p and w.q) - 0.25 * coalesce((select sum(e.exx) from c_e e where e.id = s.s and e.i >= w.p and e.i < w.q), 0) cross_,
 z.z - o.ends - o.u own
 from side s join cuts w on w.id = s.s join one o on o.id = s.s and o.k = w.k join c_z z on z.id = s.s join m_z mz on mz.id = s.mid join c_e ep on ep.id = s.s and ep.i = w.p join c_e eq on eq.id = s.s and eq.i = w.q
 join m_f fp on fp.id = s.mid and fp.i = w.p join m cp on cp.id = s.mid and cp.i = w.p join m_b bq on bq.id = s.mid and bq.i = w.q)"""


@query(_MIXED + " select cast(x as int) as i, cast(y as int) as j, cast(k as int) as k, round(1 - sum(own) / sum(cross_), 6) as cmd from seen group by 1, 2, 3")
def piece_cmd(spark, d):
    c = _in_pieces(spark, d).select(F.size("alpha").cast("string").alias("region_id"), F.col("s_nationkey").alias("sample"), "alpha", "beta", "p", "q")
    return models.divergences(models.model_pairs(c)).select("i", "j", "k", rounded("cmd").alias("cmd"))


@query(_MOMENTS + """ select cast(c.id as varchar) as region_id, round(sum(ex), 6) as da, round(sum(ex * (c.i % 7) / 100.0), 6) as db, round(sum(coalesce(exx, 0) / (10 + c.i)), 6) as dc from c join c_e e on e.id = c.id and e.i = c.i group by 1""")
def log_z_gradient(spark, d):
    c = _by_region(spark, d)
    place = F.sequence(F.lit(1), F.size("alpha"))
    profile = c.select("region_id", F.transform(place, lambda i: F.lit(1.0)).alias("n"), F.transform(place, lambda i: (i % 7) / 100.0).alias("rho"), F.transform(place, lambda i: (10 + i).cast("double")).alias("d"))
    g = models.gradients(models.moments(c), profile)
    return g.select("region_id", *[rounded(x).alias(x) for x in ("da", "db", "dc")])


@query("select p_partkey, round(p_size * (0.5 + 2.0 * p_retailprice / 10000), 6) as alpha, round(3.0 / (p_size + 1), 6) as beta from part")
def linked_parameters(spark, d):
    a, b = scalars.link(F.lit(0.5), F.lit(2.0), F.lit(3.0), F.col("p_size"), F.col("p_retailprice") / 10000, F.col("p_size") + 1)
    return table(spark, d, "part").select("p_partkey", rounded(a).alias("alpha"), rounded(b).alias("beta"))


@query(_MOMENTS + " select cast(id as varchar) as region_id, cast(i - 1 as int) as n, round(ex, 6) as ex, round(exx, 6) as exx from c_e")
def stored_moments(spark, d):
    from strandloom.plans import pipelines
    from strandloom.plans.registry import as_text, written

    c = _by_region(spark, d)
    csv = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    path = as_text(c.select(F.col("region_id").alias("chr"), F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit("0,0,0").alias("phi"), csv("alpha").alias("alpha"), csv("beta").alias("beta")), written(spark, "stored"))
    m = pipelines.stored_moments(spark, path).select(F.split("region_id", "_")[0].alias("region_id"), "ex", "exx")
    return m.select("region_id", F.posexplode("ex").alias("n", "ex"), "exx").select("region_id", "n", rounded("ex").alias("ex"), rounded(F.get("exx", F.col("n"))).alias("exx"))


#: Reads: orders, their lines as the calls of seven groups; one model for all.
_READS = """with recursive x as (select l_orderkey id, l_linenumber g, max(l_discount) * 20 lm, max(l_tax) * 20 lu from lineitem group by 1, 2),
g as (select id, unnest(range(1, 8)) i from (select distinct id from x)), h as (select g.id, g.i, 0.1 * g.i - 0.3 + coalesce(lm, 0) hp, -(0.1 * g.i - 0.3) + coalesce(lu, 0) hm, coalesce(lm, 0) ep, coalesce(lu, 0) em from g left join x on x.id = g.id and x.g = g.i)"""
_LSE = lambda x, y: f"greatest({x}, {y}) + ln(1 + exp(-abs(({x}) - ({y}))))"
_READS += f""", f as (select id, i, hp p, hm m from h where i = 1 union all select h.id, h.i, h.hp + {_LSE("f.p + 0.5", "f.m - 0.5")}, h.hm + {_LSE("f.p - 0.5", "f.m + 0.5")} from f join h on h.id = f.id and h.i = f.i + 1),
b as (select id, i, 0::double p, 0::double m from h where i = 7 union all select h.id, h.i - 1, {_LSE("0.5 + h.hp + b.p", "-0.5 + h.hm + b.m")}, {_LSE("-0.5 + h.hp + b.p", "0.5 + h.hm + b.m")} from b join h on h.id = b.id and h.i = b.i where b.i > 1),
f0 as (select 1 i, (0.1 - 0.3)::double p, (0.3 - 0.1)::double m union all select i + 1, 0.1 * (i + 1) - 0.3 + {_LSE("p + 0.5", "m - 0.5")}, -(0.1 * (i + 1) - 0.3) + {_LSE("p - 0.5", "m + 0.5")} from f0 where i < 7),
z as (select id, {_LSE("p", "m")} z from f where i = 7), z0 as (select {_LSE("p", "m")} z from f0 where i = 7)"""


def _read_likelihoods(spark, d) -> DataFrame:
    ship(spark)
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("read_id"), F.col("l_linenumber").alias("grp")).agg((F.max("l_discount") * 20).alias("log_m"), (F.max("l_tax") * 20).alias("log_u")).withColumn("region_id", F.lit("r"))
    m = spark.range(1).select(F.lit("r").alias("region_id"), F.array(*[F.lit(0.1 * i - 0.3) for i in range(1, 8)]).alias("alpha"), F.array(*[F.lit(0.5)] * 6).alias("beta"))
    return models.read_likelihoods(c, m)


@query(_READS + " select cast(id as varchar) as read_id, round(z.z - z0.z, 5) as log_lik from z, z0")
def read_log_likelihoods(spark, d):
    return _read_likelihoods(spark, d).select("read_id", rounded("log_lik", 5).alias("log_lik"))


@query(_READS + " select cast(h.id as varchar) as read_id, round(sum(exp(f.p + b.p - z) * ep + exp(f.m + b.m - z) * em), 5) as log_emission from h join f on f.id = h.id and f.i = h.i join b on b.id = h.id and b.i = h.i join z on z.id = h.id group by 1")
def expected_emissions(spark, d):
    return _read_likelihoods(spark, d).select("read_id", rounded("log_emission", 5).alias("log_emission"))


# --- regions of documents whose "an" are sites


def _sequences(spark, d) -> DataFrame:
    seq = F.replace(F.coalesce("text", F.lit("")), F.lit("an"), F.lit("CG"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chr"), seq.alias("seq"), F.length(seq).cast("long").alias("length"))


_CG = """with p as (select cast(doc_id as varchar) chr, string_split_regex(replace(text, 'an', 'CG'), '[Cc][Gg]') s, length(text) len from documents),
q as (select chr, len, unnest(s) piece, generate_subscripts(s, 1) i, len(s) n from p),
sites as (select chr, len, cast(sum(length(piece) + 2) over (partition by chr order by i) - 1 as bigint) as pos from q where i < n qualify true),
r as (select cast(doc_id as varchar) chr, length(text) len, unnest(range(1, length(text) + 1, 3000)) chrst from documents), regions as (select chr, len, chrst, least(chrst + 2999, len) chrend, chr || '_' || chrst || '_' || least(chrst + 2999, len) region_id from r),
near as (select region_id, s.chr, chrst, chrend, pos from sites s join regions r on s.chr = r.chr and pos >= greatest(1, chrst - 500) and pos + 1 <= least(r.len, chrend + 500)),
dense as (select *, count(*) over (partition by region_id order by pos range between 501 preceding and 498 following) / 1000.0 rho from near),
inside as (select * from dense where pos between chrst and chrend),
marked as (select *, case when pos - lag(pos) over (partition by region_id order by pos) <= 10 then 0 else 1 end nw, lead(pos) over (partition by region_id order by pos) - pos d_next from inside),
grouped as (select *, sum(nw) over (partition by region_id order by pos) grp from marked)"""


def _tables(spark, d) -> dict[str, DataFrame]:
    from strandloom.config import Config
    from strandloom.plans import pipelines

    ship(spark)
    return pipelines.genome_tables(_sequences(spark, d), Config(informme_mode=True))


@query(_CG + " select region_id, pos, round(rho, 6) as rho from inside")
def clipped_density(spark, d):
    return _tables(spark, d)["sites"].select("region_id", "pos", rounded("rho").alias("rho"))


@query(_CG + """, g as (select region_id, grp, min(pos) a, max(pos) b, count(*) n, avg(rho) rho from grouped group by 1, 2)
select region_id, cast(row_number() over (partition by region_id order by grp) - 1 as int) as i, round(n, 6)::double as n, round(rho, 6) as rho, coalesce(lead(a) over (partition by region_id order by grp) - b, 0)::double as d from g""")
def region_profile(spark, d):
    p = _tables(spark, d)["by_group"]
    return p.select("region_id", F.posexplode(F.arrays_zip("n", "rho", "d")).alias("i", "v")).select("region_id", "i", "v.n", rounded("v.rho").alias("rho"), "v.d")


@query(_CG + " select region_id, pos, round(rho, 6) as rho, coalesce(d_next, 0) as d from marked")
def region_info(spark, d):
    from strandloom.plans.registry import written
    from strandloom.sources import readers, writers

    info = genome.region_info(_tables(spark, d)["sites"].select("region_id", "pos", "rho"))
    path = written(spark, "info")
    writers.write_table(info.select("pos", "rho", "d", "region_id"), path)
    back = readers.read_region_info(spark, path)  # the columns that the format has
    per = info.select("region_id", "pos", "rho", "d")
    return per.join(back.select("pos", "rho", "d").distinct(), ["pos", "rho", "d"], "left_semi").select("region_id", "pos", rounded("rho").alias("rho"), "d")


@query(_CG + """, sized as (select region_id, chrst, chrend, count(*) c from inside group by 1, 2, 3 having count(*) >= 10), k as (select *, chrend - chrst + 1 sz, cast(ceil((chrend - chrst + 1) / 350.0) as bigint) kk from sized),
pieces as (select region_id, chrst, chrend, i, case when i = 1 then chrst else chrst - 1 + (sz // kk) * (i - 1) + least(sz % kk, i - 1) end lo, chrst - 1 + (sz // kk) * i + least(sz % kk, i) hi, kk from (select *, unnest(range(1, kk + 1)) i from k))
select p.region_id, cast(i as int) as k, hi - lo as size, count(s.pos) as n_cpg from pieces p left join inside s on s.region_id = p.region_id and s.pos >= lo and (s.pos < hi or i = kk) group by 1, 2, 3""")
def subregion_table(spark, d):
    t = _tables(spark, d)
    return genome.subregion_table(t["regions"].select("region_id", "chrst", "chrend"), t["sites"].select("region_id", "pos"))


@query("select doc_id, len(string_split(text, 'an')) - 1 as an, len(string_split(text, 'An')) - 1 as cap from documents")
def motif_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.count_motif(F.col("text"), "an").cast("long").alias("an"), scalars.count_motif(F.col("text"), "An").cast("long").alias("cap"))


@query("""with i as (select l_returnflag f, l_partkey * 10 as i0, l_partkey * 10 + cast(l_quantity as int) % 8 as i1, l_orderkey place from lineitem where l_linenumber = 1 and l_orderkey % 5 = 0)
select o_orderkey, coalesce(min(place), -1) as place from (select o_orderkey, ['A', 'N', 'R'][o_orderkey % 3 + 1] f, o_custkey * 7 pos from orders) o left join i on i.f = o.f and pos between i0 and i1 group by 1""")
def interval_of(spark, d):
    flag = F.get(F.array(*map(F.lit, "ANR")), (F.col("o_orderkey") % 3).cast("int"))
    points = table(spark, d, "orders").select("o_orderkey", flag.alias("f"), (F.col("o_custkey") * 7).alias("pos"))
    lines = table(spark, d, "lineitem").where("l_linenumber = 1 and l_orderkey % 5 = 0")
    intervals = lines.select(F.col("l_returnflag").alias("f"), (F.col("l_partkey") * 10).alias("i0"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("int") % 8).alias("i1"), F.col("l_orderkey").alias("place"))
    return genome.interval_of(points, intervals, "f", "pos", "i0", "i1", "place", 64).select("o_orderkey", "place")


# --- tests

_SEG = "(select c_mktsegment seg, c_nationkey % 8 rep, avg(c_acctbal) x from customer where not (c_mktsegment = 'AUTOMOBILE' and c_nationkey % 8 in (2, 5)) and not (c_mktsegment = 'BUILDING' and c_nationkey % 8 = 7) group by 1, 2)"


def _replicates(spark, d) -> DataFrame:
    """Replicates of segments, some of which lack one or two: keys, sample, grp (four and four), x."""
    rep = F.col("c_nationkey") % 8
    gone = ((F.col("c_mktsegment") == "AUTOMOBILE") & rep.isin(2, 5)) | ((F.col("c_mktsegment") == "BUILDING") & (rep == 7))
    r = table(spark, d, "customer").where(~gone).groupBy(F.col("c_mktsegment").alias("seg"), rep.alias("sample")).agg(F.avg("c_acctbal").alias("x"))
    return r.withColumn("grp", F.when(F.col("sample") < 4, 1).otherwise(2))


def _pair_divergences(spark, d) -> DataFrame:
    r = _replicates(spark, d)
    two = r.select("seg", F.col("sample").alias("i"), F.col("x").alias("xi")).join(r.select("seg", F.col("sample").alias("j"), F.col("x").alias("xj")), "seg").where("i < j")
    return two.select("seg", "i", "j", F.abs((F.col("xi") - F.col("xj")) / 10000).alias("cmd"))


_MASKED = f"""with r as {_SEG}, v as (select seg, rep, x, row_number() over (partition by seg order by rep) - 1 i, count(*) over (partition by seg) n, count(*) filter (rep < 4) over (partition by seg) n1 from r),
j as (select unnest(range(0, 256)) j), m as (select seg, n, n1, j from (select distinct seg, n, n1 from v), j where j < pow(2, n) and bit_count(j) = n1)"""


@query(_MASKED + """, c as (select a.seg, a.i, b.i k, abs((a.x - b.x) / 10000) cmd from v a join v b on a.seg = b.seg and a.i < b.i),
t as (select m.seg, j, n1, n, avg(cmd) t from m join c on c.seg = m.seg and ((j >> c.i::int) & 1) <> ((j >> c.k::int) & 1) group by 1, 2, 3, 4), o as (select seg, t stat from t where j = pow(2, n1) - 1)
select t.seg, round(stat, 6) as stat, case when count(*) > 20 then round(count(*) filter (t >= stat - 1e-12) / count(*), 6) end as p from t join o on o.seg = t.seg group by t.seg, stat""")
def tcmd_unmatched(spark, d):
    t = comparison.divergence_test(_pair_divergences(spark, d), _replicates(spark, d), ["seg"])
    return t.select("seg", rounded("stat").alias("stat"), rounded("p").alias("p"))


@query(_MASKED + """, t as (select m.seg, m.j, m.n, m.n1, sum(case when (m.j >> v.i::int) & 1 = 1 then x else 0 end) / m.n1 - sum(case when (m.j >> v.i::int) & 1 = 1 then 0 else x end) / (m.n - m.n1) t from m join v on v.seg = m.seg group by 1, 2, 3, 4),
o as (select seg, t stat from t where j = pow(2, n1) - 1) select t.seg, round(stat, 4) as stat, case when count(*) > 20 then round(count(*) filter (abs(t) >= abs(stat) - 1e-9) / count(*), 6) end as p from t join o on o.seg = t.seg group by t.seg, stat""")
def unequal_groups(spark, d):
    from pyspark.sql import Window as W

    r = _replicates(spark, d).withColumn("i", F.row_number().over(W.partitionBy("seg").orderBy("grp", "sample")) - 1)
    return comparison.unmatched_test(r, ["seg"]).select("seg", rounded("stat", 4).alias("stat"), rounded("p").alias("p"))


@query(f"with r as {_SEG} select a.seg, avg(abs((a.x - b.x) / 10000)) is not null as has, round(avg(abs((a.x - b.x) / 10000)), 6) as stat from r a join r b on a.seg = b.seg and a.rep + 4 = b.rep group by 1")
def tcmd_matched(spark, d):
    t = comparison.mean_divergence(_pair_divergences(spark, d).where("j - i = 4"), ["seg"])
    return t.select("seg", F.col("stat").isNotNull().alias("has"), rounded("stat").alias("stat"))


@query(f"with r as {_SEG} select a.seg, a.rep as i, b.rep as j from r a join r b on a.seg = b.seg and a.rep < 4 and b.rep >= 4")
def group_pairs(spark, d):
    return comparison.group_pairs(_replicates(spark, d), ["seg"]).select("seg", "i", "j")


# --- evaluation


@query(f"with r as (select threshold, round(tp / (tp + fp), 3) pr, round(tp / p, 3) rc from {_POINTS} where tp + fp > 0 and p > 0) select threshold, rc as recall, pr as precision from (select *, lag(pr) over (order by rc, threshold) b from r) where pr < b")
def precision_drops(spark, d):
    return evaluation.precision_drops(evaluation.precision_recall(_scored(spark, d), F.col("t"), F.col("s"), _TH))


@query(f"with r as (select threshold, round(tp / (tp + fp), 3) pr, round(tp / p, 3) rc from {_POINTS} where tp + fp > 0 and p > 0), k as (select * from (select *, lag(pr) over (order by rc, threshold) b from r) where pr < b) select round(coalesce(sum((nx - rc) * pr), 0), 6) as auc from (select *, lead(rc) over (order by rc, threshold) nx from k)")
def precision_recall_auc(spark, d):
    return evaluation.precision_recall_auc(evaluation.precision_recall(_scored(spark, d), F.col("t"), F.col("s"), _TH)).select(rounded("auc").alias("auc"))


@query("""with p as (select o_orderstatus g, o_custkey % 3 = 0 t, round(o_totalprice / 600000, 6) p from orders), s as (select g, unnest(range(0, 101)) / 100.0 x from (select distinct g from p)),
c as (select s.g, x, count(*) filter (t and p <= x) tp, count(*) filter (not t and p <= x) fp from s join p on p.g = s.g group by 1, 2), n as (select g, count(*) filter (t and p <= 1) a, count(*) filter (not t and p <= 1) b from p group by 1)
select c.g, round(x, 6)::double as threshold, round(tp / (a + 1), 6) as tpr, round(fp / (b + 1), 6) as fpr from c join n on n.g = c.g""")
def pvalue_roc(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), (F.col("o_custkey") % 3 == 0).alias("t"), F.round(F.col("o_totalprice") / 600000, 6).alias("p"))
    r = evaluation.pvalue_roc(o, F.col("t"), F.col("p"), ("g",), 100)
    return r.select("g", rounded("threshold").alias("threshold"), rounded("tpr").alias("tpr"), rounded("fpr").alias("fpr"))


@query("select lang, count(*) as n, min(n_chars) as least, max(n_chars) as most, cast(sum(n_chars) as bigint) as sum, round(avg((n_chars <= 500)::int), 6) as upto_500, round(avg((n_chars <= 2000)::int), 6) as upto_2000 from documents group by 1")
def summary_at_cuts(spark, d):
    s = evaluation.summary(table(spark, d, "documents"), ["lang"], F.col("n_chars"), [500.0, 2000.0])
    return s.select("lang", "n", "least", "most", "sum", rounded(F.get("upto", F.lit(0))).alias("upto_500"), rounded(F.get("upto", F.lit(1))).alias("upto_2000"))


@query("with a as (select avg(n_chars)::double t from documents), e as (select unnest([0, 100, 500, 1000, 5000, 20000]) a, unnest([100, 500, 1000, 5000, 20000, null]) b) select e.a as low, round(exp(-e.a / t) - exp(-e.b / t), 6) as share from e, a where b is not null")
def exponential_shares(spark, d):
    edges = [0.0, 100.0, 500.0, 1000.0, 5000.0, 20000.0]
    t = evaluation.exponential_fit(table(spark, d, "documents"), F.col("n_chars"))
    return t.select(F.posexplode(evaluation.exponential_shares(F.col("theta"), edges)).alias("i", "share")).select(F.get(F.lit(edges), F.col("i")).cast("int").alias("low"), rounded("share").alias("share"))


@query("select vec_id, cast(len(embedding) as int) as n, round(list_avg(embedding::double[]), 6) as mean, round(list_stddev_samp(embedding::double[]), 6) as std from embeddings")
def row_moments(spark, d):
    e = table(spark, d, "embeddings").withColumn("signal", F.col("embedding").cast("array<double>"))
    return evaluation.row_moments(e, ["vec_id"], "signal").select("vec_id", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("with a as (select l_suppkey, avg(l_discount) x from lineitem where l_returnflag = 'A' group by 1), b as (select l_suppkey, avg(l_discount) y from lineitem where l_returnflag = 'R' and l_suppkey % 3 > 0 group by 1) select a.l_suppkey, round(x, 6) as x, round(y, 6) as y from a join b on a.l_suppkey = b.l_suppkey")
def paired_estimates(spark, d):
    mean = lambda f: table(spark, d, "lineitem").where(f).groupBy("l_suppkey").agg(F.avg("l_discount").alias("v"))
    p = evaluation.paired_estimates(mean("l_returnflag = 'A'"), mean("l_returnflag = 'R' and l_suppkey % 3 > 0"), ["l_suppkey"], "v")
    return p.select("l_suppkey", rounded("x").alias("x"), rounded("y").alias("y"))


@query("select o_orderkey from orders order by md5('17:' || o_orderkey), o_orderkey limit 1000")
def sampled_rows(spark, d):
    return simulation.sample_rows(table(spark, d, "orders"), ["o_orderkey"], 1000).select("o_orderkey")
