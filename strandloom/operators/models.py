"""Models of regions: fitting and summaries in grouped kernels, one Python call an Arrow batch or group."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import ising
from strandloom.session import settled

SUMMARY = "region_id string, log_z double, ex array<double>, exx array<double>, mml array<double>, nme array<double>"


def _pieces(p, q):
    return [(int(a), int(b)) if a is not None and not np.isnan(a) else None for a, b in zip(p, q, strict=True)]


def summaries(models: DataFrame, keys: tuple[str, ...] = ("sample", "region_id")) -> DataFrame:
    """keys, log_z, ex, exx, mml, nme per piece, of rows with alpha, beta, p, q.

    ``p``, ``q``: arrays of the first and last site (from 0) of each piece; null for an empty one.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", log_z double, ex array<double>, exx array<double>, mml array<double>, nme array<double>"

    def run(batches):
        for pdf in batches:
            rows = []
            for r, s in zip(pdf.itertuples(index=False), ising.summarise_all(pdf["alpha"], pdf["beta"]), strict=True):
                cut = _pieces(r.p, r.q)
                rows.append((*[getattr(r, k) for k in keys], s.log_z, s.ex, s.exx, [ising.mml(s, *c) if c else None for c in cut], [ising.nme(s, *c) if c else None for c in cut]))
            yield pd.DataFrame(rows, columns=[*keys, "log_z", "ex", "exx", "mml", "nme"])

    return models.select(*[F.col(k).cast("string").alias(k) for k in keys], "alpha", "beta", "p", "q").mapInPandas(run, schema)


def _sides(pdf: pd.DataFrame):
    """(row, summary of i, of j, of their mixture) of a batch of pairs."""
    one, two = (ising.summarise_all(pdf[f"alpha_{x}"], pdf[f"beta_{x}"]) for x in "ij")
    mixed = ising.summarise_all([(a.alpha + b.alpha) / 2 for a, b in zip(one, two, strict=True)], [(a.beta + b.beta) / 2 for a, b in zip(one, two, strict=True)])
    return zip(pdf.itertuples(index=False), one, two, mixed, strict=True)


def divergences(pairs: DataFrame) -> DataFrame:
    """i, j, region_id, k, cmd of rows with alpha_i, beta_i, alpha_j, beta_j, p, q."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r, a, b, mix in _sides(pdf):
                rows += [(r.i, r.j, r.region_id, k, ising.cmd(a, b, mix, *c)) for k, c in enumerate(_pieces(r.p, r.q)) if c]
            yield pd.DataFrame(rows, columns=["i", "j", "region_id", "k", "cmd"])

    return pairs.select("i", "j", "region_id", "alpha_i", "beta_i", "alpha_j", "beta_j", "p", "q").mapInPandas(run, "i int, j int, region_id string, k int, cmd double")


def whole_divergences(pairs: DataFrame) -> DataFrame:
    """i, j, region_id, cmd (kept in [0, 1]), kl (of j from i) of whole regions, from stored alpha and beta."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r, a, b, mix in _sides(pdf):
                c = ising.cmd(a, b, mix, 0, len(a.alpha) - 1)
                rows.append((r.i, r.j, r.region_id, min(1.0, max(0.0, c)), ising.kl(a, b)))
            yield pd.DataFrame(rows, columns=["i", "j", "region_id", "cmd", "kl"])

    return pairs.select("i", "j", "region_id", "alpha_i", "beta_i", "alpha_j", "beta_j").mapInPandas(run, "i int, j int, region_id string, cmd double, kl double")


def moments(models: DataFrame, second: bool = False) -> DataFrame:
    """region_id, ex, exx, px (P(X = 1) of each site), corr: of alpha, beta. ``second`` adds E[X_i X_j] as
    rows, whose size is the square of a chain's."""
    names = ["region_id", "ex", "exx", "px", "corr", *(["second"] if second else [])]

    def run(batches):
        for pdf in batches:
            rows = []
            for region, s in zip(pdf["region_id"], ising.summarise_all(pdf["alpha"], pdf["beta"]), strict=True):
                rows.append((region, s.ex, s.exx, s.p[:, 1], ising.correlations(s), *([ising.second_moments(s).tolist()] if second else [])))
            yield pd.DataFrame(rows, columns=names)

    schema = "region_id string, ex array<double>, exx array<double>, px array<double>, corr array<double>" + (", second array<array<double>>" if second else "")
    return models.select("region_id", "alpha", "beta").mapInPandas(run, schema)


def read_likelihoods(calls: DataFrame, models: DataFrame) -> DataFrame:
    """region_id, read_id, log_lik, log_emission: log p(y) of each read and E[log p(y | X)] under its posterior.

    ``calls``: region_id, read_id, grp (from 1), log_m, log_u; ``models``: region_id, alpha, beta.
    One row a read is made first, so a region with any number of reads is spread over tasks.
    """
    per = calls.groupBy("region_id", "read_id").agg(F.collect_list(F.struct(F.col("grp").cast("int").alias("grp"), F.col("log_m").cast("double").alias("log_m"), F.col("log_u").cast("double").alias("log_u"))).alias("v"))
    rows = per.join(models.select("region_id", "alpha", "beta"), "region_id")
    flat = rows.select("region_id", "read_id", "alpha", "beta", *[F.col(f"v.{c}").alias(c) for c in ("grp", "log_m", "log_u")])
    names = ["region_id", "read_id", "log_lik", "log_emission"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            offsets = lambda k: np.asarray(b.column(k).offsets) - b.column(k).offsets[0].as_py()
            values = lambda k: b.column(k).flatten().to_numpy(zero_copy_only=False)
            log_lik, emission = ising.read_statistics((values(2), offsets(2)), (values(3), offsets(3)), (values(4) - 1, offsets(4)), values(6), values(5))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(log_lik), pa.array(emission)], names)

    types = [per.schema[c].dataType.simpleString() for c in names[:2]]
    return flat.mapInArrow(run, f"region_id {types[0]}, read_id {types[1]}, log_lik double, log_emission double")


def model_pairs(models: DataFrame) -> DataFrame:
    """All pairs i < j of the models of a region: a self equi-join on the region."""
    side = lambda x: models.select("region_id", F.col("sample").alias(x), F.col("alpha").alias(f"alpha_{x}"), F.col("beta").alias(f"beta_{x}"))
    pieces = models.groupBy("region_id").agg(F.min(F.struct("p", "q")).alias("c")).select("region_id", "c.p", "c.q")
    return side("i").join(side("j"), "region_id").where("i < j").join(pieces, "region_id")


def alphas(profile: DataFrame) -> DataFrame:
    """Adds alpha, beta from phi and the arrays n, rho, d of a region: column arithmetic."""
    a = F.transform(F.arrays_zip("n", "rho"), lambda x: x.n * (F.col("phi")[0] + F.col("phi")[1] * x.rho))
    b = F.transform(F.slice("d", 1, F.size("rho") - 1), lambda x: F.col("phi")[2] / x)
    return profile.withColumns({"alpha": a, "beta": b})


def fit_regions(calls: DataFrame, profile: DataFrame, reads: DataFrame, starts: int = 10, iters: int = 20, seed: int = 17, group: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """region_id, phi, log_lik, converged: EM per region, whose reads and groups make one group.

    ``profile``: region_id, n, rho, d (arrays over groups). ``reads`` counts the reads with no
    call too. Seeds come from the region's id, so a retried task gives the same fit.
    """
    full = reads.join(calls, ["region_id", "read_id"], "left").join(profile.select("region_id", "n", "rho", "d"), "region_id")
    # a fit is dear and its rows few: a set number of partitions keeps them from being merged by bytes
    full = full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, rho, d = (np.asarray(pdf[c].iloc[0], float) for c in ("n", "rho", "d"))
        row = pdf["read_id"].factorize()[0]
        u = np.full((row.max() + 1, len(n)), np.nan)
        m = u.copy()
        has = pdf["grp"].notna().to_numpy()
        at = (row[has], pdf["grp"][has].to_numpy().astype(int) - 1)
        u[at], m[at] = pdf["log_u"][has], pdf["log_m"][has]
        f = ising.fit_em(u, m, n, rho, d, starts, iters, zlib.crc32(f"{key}{seed}".encode()))
        return pd.DataFrame([(*key, f.phi if f.converged else None, f.q if f.converged else None, f.converged)], columns=[*group, "phi", "log_lik", "converged"])

    return full.groupBy(*group).applyInPandas(run, ", ".join(f"{g} string" for g in group) + ", phi array<double>, log_lik double, converged boolean")


def packed_calls(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """region_id and arrays read_id, grp, log_m, log_u: a row a region. Every read of ``reads`` stands there, with a
    null group too, so reads without a call count. A region's calls make one row, as they make one group of a fit."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("grp", "int"), ("log_m", "double"), ("log_u", "double"))]
    rows = calls.select("region_id", "read_id", F.col("grp").cast("int").alias("grp"), F.col("log_m").cast("double").alias("log_m"), F.col("log_u").cast("double").alias("log_u"))
    both = rows.unionByName(reads.select("region_id", "read_id", *nothing))
    v = F.collect_list(F.struct("read_id", "grp", "log_m", "log_u"))
    return both.groupBy("region_id").agg(v.alias("v")).select("region_id", *[F.col(f"v.{c}").alias(c) for c in ("read_id", "grp", "log_m", "log_u")])


def halves(region: str, perm: int, first: int, reads: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the reads (in order of their ids) dealt to the two samples by permutation ``perm`` of a region."""
    order = np.random.default_rng(zlib.crc32(f"{region}#{perm}#{seed}".encode())).permutation(reads)
    return order[:first], order[first:]


def _differences(one, two, mix, pieces) -> dict[tuple[str, int], float]:
    """Statistics of two summaries by (test, piece); NaN where one has no value."""
    out = {}
    for k, c in enumerate(pieces):
        if c:
            out["tmml", k] = abs(ising.mml(one, *c) - ising.mml(two, *c))
            out["tnme", k] = abs(ising.nme(one, *c) - ising.nme(two, *c))
            out["tcmd", k] = ising.cmd(one, two, mix, *c)
    return out


def permuted_hits(packed: DataFrame, units: DataFrame, sites: DataFrame, observed: DataFrame, permutations: int, starts: int = 10, iters: int = 20, seed: int = 17, blocks: int = 8, tie: float = 0.0) -> DataFrame:
    """region_id, test, k, n, hits: permutations of a region's reads that have a value, and those that reach ``observed``.

    ``packed``: ``packed_calls`` whose reads begin with their sample's number and ``:``; ``units``: region_id,
    n, rho, d of what calls are on; ``sites``: region_id, n, rho, d of sites, p, q of pieces; ``observed``:
    region_id, test, k, stat. A region's calls are sent once for each of ``blocks`` blocks of permutations, which
    are index arrays in the task: what is shuffled doesn't grow with their number. Draws come from the region's
    id and the permutation's number, so results don't depend on blocks or retries.
    """
    stat = F.collect_list(F.struct("test", "k", "stat"))
    seen = observed.where("stat is not null").groupBy("region_id").agg(stat.alias("o")).select("region_id", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("test", "k", "stat")])
    of_sites = sites.select("region_id", *[F.col(c).alias(f"s_{c}") for c in ("n", "rho", "d")], "p", "q")
    rows = packed.join(units.select("region_id", "n", "rho", "d"), "region_id").join(of_sites, "region_id").join(seen, "region_id")
    blocks = max(1, min(blocks, permutations))
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # fits are dear and rows few: a set number of partitions keeps them from being merged by bytes
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "region_id", "block")

    def one(r) -> list[tuple]:
        ids, row = np.unique(np.asarray(r.read_id, object).astype(str), return_inverse=True)
        u = np.full((len(ids), len(r.n)), np.nan)
        m = u.copy()
        grp = pd.array(r.grp, dtype="Float64").to_numpy(float, na_value=np.nan)
        has = ~np.isnan(grp)
        at = (row[has], grp[has].astype(int) - 1)
        u[at], m[at] = np.asarray(r.log_u, float)[has], np.asarray(r.log_m, float)[has]
        first = int(sum(i.startswith("0:") for i in ids))
        if not 0 < first < len(ids):
            return []
        n, rho, d = (np.asarray(x, float) for x in (r.n, r.rho, r.d))
        pairs = []
        for perm in range(1 + r.block, permutations + 1, blocks):
            fits = []
            for half, pick in enumerate(halves(r.region_id, perm, first, len(ids), seed)):
                fits.append(ising.fit_em(u[pick], m[pick], n, rho, d, starts, iters, zlib.crc32(f"{(f'{r.region_id}#{perm}#{half}',)}{seed}".encode())))
                if not fits[-1].converged:
                    break
            else:
                pairs.append([ising.link(f.phi, np.asarray(r.s_n, float), np.asarray(r.s_rho, float), r.s_d) for f in fits])
        mixed = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in pairs]
        flat = [x for a, b in pairs for x in (a, b)] + mixed
        sums = ising.summarise_all([a for a, _ in flat], [b for _, b in flat])
        count: dict[tuple[str, int], list[int]] = {}
        seen = dict(zip(zip(r.o_test, r.o_k, strict=True), r.o_stat, strict=True))
        pieces = _pieces(r.p, r.q)
        for i in range(len(pairs)):
            for key, t in _differences(sums[2 * i], sums[2 * i + 1], sums[2 * len(pairs) + i], pieces).items():
                # observed pieces are numbered from 0 as well
                if key in seen and not np.isnan(t):
                    c = count.setdefault(key, [0, 0])
                    c[0] += 1
                    c[1] += bool(t >= seen[key] - tie)
        return [(r.region_id, test, k, n_, hits) for (test, k), (n_, hits) in count.items()]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame(one(r), columns=["region_id", "test", "k", "n", "hits"])

    parts = dealt.mapInPandas(run, "region_id string, test string, k int, n long, hits long")
    return parts.groupBy("region_id", "test", "k").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def _read_rows(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """region_id, grp, log_m, log_u (arrays over what was observed): a row a read."""
    per = reads.select("region_id", "read_id").distinct().join(calls, ["region_id", "read_id"], "left").groupBy("region_id", "read_id")
    kept = F.when(F.col("grp").isNotNull(), F.struct("grp", "log_m", "log_u"))
    return per.agg(F.collect_list(kept).alias("v")).select("region_id", *[F.col(f"v.{c}").alias(c) for c in ("grp", "log_m", "log_u")])


def _read_sums(what: str):
    """Sums over the reads of each region in a batch, for all starts that count."""

    def run(batches):
        for pdf in batches:
            for region, part in pdf.groupby("region_id", sort=False):
                r = part.iloc[0]
                on = np.asarray(r["going"] if what == "stats" else r["done"], bool)
                terms, phi = ising.Terms(r["n"], r["rho"], r["d"]), np.asarray(r["phi"]).reshape(-1, 3)[on]
                u = np.full((len(part), len(terms.n)), np.nan)
                m = u.copy()
                for k, (g, lm, lu) in enumerate(zip(part["grp"], part["log_m"], part["log_u"], strict=True)):
                    at = np.asarray(g, int) - 1
                    u[k, at], m[k, at] = lu, lm
                e = ising.evidence_of(u, m)
                total = terms.expected(phi, e).sum(axis=1) if what == "stats" else terms.log_likelihoods(phi, e).sum(axis=1)
                yield pd.DataFrame({"region_id": [region], "k": [list(range(total.size))], "x": [total.ravel()], "reads": [len(part)]})

    return run


def _summed(rows: DataFrame, now: DataFrame, what: str) -> DataFrame:
    """region_id, x (array of sums over reads), reads: partial sums of batches, then of regions."""
    parts = rows.join(now, "region_id").mapInPandas(_read_sums(what), "region_id string, k array<int>, x array<double>, reads long")
    n = parts.groupBy("region_id").agg(F.sum("reads").alias("reads"))
    each = parts.select("region_id", F.explode(F.arrays_zip("k", "x")).alias("e")).groupBy("region_id", "e.k").agg(F.sum("e.x").alias("x"))
    return each.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).select("region_id", F.transform("v", lambda e: e.x).alias("x")).join(n, "region_id")


def expected_statistics(calls: DataFrame, profile: DataFrame, reads: DataFrame, phi: DataFrame) -> DataFrame:
    """region_id, reads, ta, tb, tc: means over reads of the statistics that each read's posterior at ``phi``
    (region_id, phi) expects. Less those of the model (``gradients``) they are the gradient of the likelihood."""
    now = profile.select("region_id", "n", "rho", "d").join(phi.where("phi is not null").select("region_id", "phi"), "region_id")
    now = now.withColumns({"going": F.array(F.lit(True)), "done": F.array(F.lit(False))})
    return _summed(_read_rows(calls, reads), now, "stats").select("region_id", "reads", *[(F.get("x", F.lit(i)) / F.col("reads")).alias(c) for i, c in enumerate(("ta", "tb", "tc"))])


def fit_regions_by_reads(calls: DataFrame, profile: DataFrame, reads: DataFrame, starts: int = 10, iters: int = 20, seed: int = 17) -> DataFrame:
    """region_id, phi, log_lik, converged, as ``fit_regions``, for regions with any number of reads.

    A region is no group: each step joins the parameters of all starts, one row a region, to the reads,
    sums their expected statistics up where the reads are (a batch at a time) and then by region, and
    solves the M-step on that row. Starts are compared by all reads. Seeds are those of ``fit_regions``.
    """
    rows = settled(_read_rows(calls, reads))
    state = "region_id string, n array<double>, rho array<double>, d array<double>, phi array<double>, done array<boolean>, going array<boolean>"

    def first(batches):
        for pdf in batches:
            pdf["phi"] = [ising.random_starts(starts, zlib.crc32(f"{(r,)}{seed}".encode())).ravel() for r in pdf["region_id"]]
            pdf["done"], pdf["going"] = [[False] * starts] * len(pdf), [[True] * starts] * len(pdf)
            yield pdf

    def stepped(opening: bool):
        def run(batches):
            for pdf in batches:
                for i, r in enumerate(pdf.itertuples(index=False)):
                    phi, done, going = np.array(r.phi).reshape(-1, 3), np.array(r.done, bool), np.array(r.going, bool)
                    phi[going], done[going], on = ising.m_step(ising.Terms(r.n, r.rho, r.d), phi[going], np.asarray(r.x).reshape(-1, 3) / r.reads, opening)
                    going[going] = on
                    pdf.at[i, "phi"], pdf.at[i, "done"], pdf.at[i, "going"] = phi.ravel(), done, going
                yield pdf[["region_id", "n", "rho", "d", "phi", "done", "going"]]

        return run

    moving = F.exists("going", lambda x: x)
    now = settled(profile.select("region_id", "n", "rho", "d").join(rows.select("region_id").distinct(), "region_id").select("region_id", "n", "rho", "d").mapInPandas(first, state))
    for it in range(iters):
        going = now.where(moving)
        if not going.limit(1).count():
            break
        new = going.join(_summed(rows, going, "stats"), "region_id").mapInPandas(stepped(not it), state)
        now = settled(now.where(~moving).unionByName(new))
    some = now.where(F.exists("done", lambda x: x))
    likely = some.join(_summed(rows, some, "log_lik"), "region_id")
    mean = F.transform("x", lambda v: v / F.col("reads"))
    ends = F.filter(F.transform("done", lambda d, i: F.when(d, F.slice("phi", i * 3 + 1, 3))), lambda p: p.isNotNull())
    best = likely.select("region_id", mean.alias("q"), ends.alias("phis")).withColumn("log_lik", F.array_max("q"))
    fits = best.select("region_id", F.get("phis", (F.array_position("q", F.col("log_lik")) - 1).cast("int")).alias("phi"), "log_lik", F.lit(True).alias("converged"))
    return now.select("region_id").join(fits, "region_id", "left").withColumn("converged", F.coalesce("converged", F.lit(False)))


def simulate_calls(models: DataFrame, reads: int, sd: float = 2.0, observed: float = 1.0, seed: int = 17, mean: float = 2.0) -> DataFrame:
    """region_id, read_id, grp, log_m, log_u: exact draws of ``reads`` reads with Gaussian emissions around -mean and mean."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng(zlib.crc32(f"{r.region_id}{seed}".encode()))
                x = ising.sample(r.alpha, np.asarray(r.beta, float), reads, rng)
                u, m = ising.emissions(x, rng, sd, mean)
                i, g = np.nonzero(rng.random(x.shape) < observed)
                yield pd.DataFrame({"region_id": r.region_id, "read_id": [f"{r.region_id}:{k}" for k in i], "grp": g + 1, "log_m": m[i, g], "log_u": u[i, g]})

    return models.select("region_id", "alpha", "beta").mapInPandas(run, "region_id string, read_id string, grp int, log_m double, log_u double")


def gradients(summarised: DataFrame, profile: DataFrame) -> DataFrame:
    """region_id, da, db, dc: the gradient of log Z by phi, the expected sufficient statistics.

    ``summarised``: region_id, ex, exx; ``profile``: region_id, n, rho, d.
    """
    both = summarised.select("region_id", "ex", "exx").join(profile.select("region_id", "n", "rho", "d"), "region_id")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    weighted = F.zip_with("n", "ex", lambda n, x: n * x)
    return both.select("region_id", total(weighted).alias("da"), total(F.zip_with(weighted, "rho", lambda x, r: x * r)).alias("db"), total(F.zip_with("exx", F.slice("d", 1, F.size("exx")), lambda x, d: x / d)).alias("dc"))
