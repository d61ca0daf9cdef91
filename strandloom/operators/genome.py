"""Sites, groups, densities, regions: genome structure as DataFrames (1-based, inclusive)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.operators import scans
from strandloom.session import settled, ship


def _never_overlap(pattern: str, width: int) -> bool:
    """Whether matches of a pattern of one or two characters can't share one; False if that isn't plain."""
    if width == 1:
        return True
    if width > 2 or not pattern.isascii():
        return False
    chars = [chr(c) for c in range(128)]
    pairs = [(a, b) for a in chars for b in chars if re.fullmatch(pattern, a + b)]
    return bool(pairs) and not {a for a, _ in pairs} & {b for _, b in pairs}


def _found(cut: DataFrame, key: str, pattern: str, width: int, entries: int) -> DataFrame:
    """key, tile, size, p: lengths between the matches of a tile's text, from each of the first places on."""
    lengths = lambda o: F.transform(F.split(F.substring("text", o + 1, 1 << 30) if o else F.col("text"), pattern, -1), F.length)
    return cut.where("text is not null").select(key, "tile", F.length("text").alias("size"), F.array(*[lengths(o) for o in range(entries)]).alias("p"))


def motif_positions(df: DataFrame, key: str, seq: str, pattern: str = "[Cc][Gg]", width: int = 2, tile: int = scans.BLOCK) -> DataFrame:
    """key, n (from 0), pos of every leftmost non-overlapping match of a pattern of ``width`` characters.

    Sequences longer than ``tile`` are searched in tiles that reach ``width`` - 1 characters into the next,
    whose search begins behind a match that does. Numbers are those in the tile and the matches of
    all tiles before. Shorter sequences are searched where they are.
    """
    text = F.col(seq)
    short = df.where(F.length(text) <= tile).select(key, F.lit(0).cast("long").alias("tile"), text.alias("text"))
    near = _found(short, key, pattern, width, 1).select(key, "tile", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("carry"), F.get("p", F.lit(0)).alias("p"))
    far = _far(scans.tiles(df.where(F.length(text) > tile), key, seq, width - 1, tile), key, pattern, width, tile)
    return _positions(near.unionByName(far), key, width, tile)


def motif_positions_of_tiles(cut: DataFrame, key: str, pattern: str = "[Cc][Gg]", width: int = 2, tile: int = scans.BLOCK) -> DataFrame:
    """``motif_positions`` of sequences that come in tiles: key, tile (from 0), text, which reaches ``width`` - 1
    characters into the next tile. No sequence is ever whole (``readers.fasta_tiles`` reads a file so)."""
    return _positions(_far(cut, key, pattern, width, tile), key, width, tile)


def _far(cut: DataFrame, key: str, pattern: str, width: int, tile: int) -> DataFrame:
    # the lengths between matches are read three times: by tiles, by keys, and at last
    long = settled(_found(cut, key, pattern, width, 1 if _never_overlap(pattern, width) else width))
    return long.join(_carries(long, key, tile), [key, "tile"]).withColumn("entry", F.least(F.col("entry"), F.size("p") - 1)).select(key, "tile", "entry", "carry", F.get("p", F.col("entry")).alias("p"))


def _positions(found: DataFrame, key: str, width: int, tile: int) -> DataFrame:
    rows = found.select(key, "tile", "entry", "carry", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("i", "len"))
    upto = W.partitionBy(key, "tile").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = F.col("tile") * tile + F.col("entry") + F.sum(F.col("len") + width).over(upto) - width + 1
    return rows.select(key, (F.col("i") + F.col("carry")).cast("int").alias("n"), pos.cast("long").alias("pos"))


def _carries(found: DataFrame, key: str, tile: int) -> DataFrame:
    """key, tile, entry (characters of a tile that a match before it takes), carry (matches of all tiles before).

    A tile is a few numbers here: for each entry the next one and the matches. A string has at most
    2**31 characters, so a key has at most 32,768 tiles of 65,536.
    """
    per = F.transform("p", lambda p: F.struct(F.greatest(F.lit(0), F.col("size") - F.element_at(p, -1) - tile).alias("next"), (F.size(p) - 1).cast("long").alias("n")))
    v = F.sort_array(F.collect_list(F.struct("tile", "f")))
    lists = found.select(key, "tile", per.alias("f")).groupBy(key).agg(v.alias("v"))
    kind = "array<struct<tile:bigint,entry:int,carry:bigint>>"
    start = F.struct(F.lit(0).alias("entry"), F.lit(0).cast("long").alias("carry"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        own = F.get(x.f, F.least(s.entry, F.size(x.f) - 1))
        return F.struct(own.next.alias("entry"), (s.carry + own.n).alias("carry"), F.concat(s.out, F.array(F.struct(x.tile.alias("tile"), s.entry.alias("entry"), s.carry.alias("carry")))).alias("out"))

    return lists.select(key, F.explode(F.aggregate("v", start, step, lambda s: s.out)).alias("e")).select(key, "e.tile", "e.entry", "e.carry")


def gap_groups(sites: DataFrame, key: str, min_dist: int = 10, pad: int = 5, block: int | None = scans.BLOCK) -> DataFrame:
    """key, grp (from 1), grp_start, grp_end, n_cpg, first_pos, last_pos: a gap over ``min_dist`` starts a group.

    Intervals are padded by ``pad``; a key with a single site keeps it unpadded. Groups are numbered by
    a scan over blocks, so one that crosses blocks is one group; ``block`` None: keys are short.
    """
    near = scans.scanned(sites.select(key, "pos"), key, "pos", min_dist, block)
    alone = F.max((F.col("before").isNull() & F.col("after").isNull()))
    g = near.groupBy(key, F.col("upto").cast("int").alias("grp")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n_cpg"), alone.alias("alone"))
    edge = F.when(F.col("alone"), 0).otherwise(pad)
    return g.select(key, "grp", (F.col("first_pos") - edge).alias("grp_start"), (F.col("last_pos") + edge).alias("grp_end"), "n_cpg", "first_pos", "last_pos")


def site_distances(sites: DataFrame, key: str, block: int | None = scans.BLOCK) -> DataFrame:
    """Adds d_next: distance to the next site, null at the end."""
    return scans.scanned(sites, key, "pos", width=block).withColumn("d_next", F.col("after") - F.col("pos")).drop("before", "after", "upto")


def group_distances(groups: DataFrame, key: str, block: int | None = scans.BLOCK) -> DataFrame:
    """Adds d_next: from a group's last site to the next group's first."""
    return scans.scanned(groups, key, "first_pos", width=block).withColumn("d_next", F.col("after") - F.col("last_pos")).drop("before", "after", "upto")


def site_density(sites: DataFrame, key: str, half: int = 500, block: int = scans.BLOCK) -> DataFrame:
    """Adds rho: sites wholly inside pos - half - 1 .. pos + half - 1, per 2 * half bases.

    The window lies one base to the left (the offset of a site in its context is counted from 0).
    Blocks get the sites within reach of their ends too, and count on their own.
    """
    b = lambda x: F.floor(x / block)
    dealt = sites.withColumn("__b", F.explode(F.sequence(b(F.col("pos") - half - 1), b(F.col("pos") + half + 1))))
    near = W.partitionBy(key, "__b").orderBy("pos").rangeBetween(-half - 1, half - 2)
    return dealt.withColumn("rho", F.count(F.lit(1)).over(near) / (2.0 * half)).where(F.col("__b") == b(F.col("pos"))).drop("__b")


def region_density(sites: DataFrame, regions: DataFrame, chr_size: Column, half: int = 500) -> DataFrame:
    """Density of the sites of regions with the context clipped at a region's padded ends.

    ``sites``: chr, pos; ``regions``: region_id, chr, chrst, chrend. Sites are matched to the
    padded regions by blocks, then counted by a range frame.
    """
    block = 4096
    ctx0, ctx1 = F.greatest(F.lit(1), F.col("chrst") - half), F.least(chr_size, F.col("chrend") + half)
    r = regions.withColumns({"c0": ctx0, "c1": ctx1}).withColumn("blk", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor(F.col("c1") / block))))
    s = sites.withColumn("blk", F.floor(F.col("pos") / block))
    inside = s.join(r, ["chr", "blk"]).where("pos >= c0 and pos + 1 <= c1")
    # the context clips by itself: no site outside of it is in the frame
    return site_density(inside, "region_id", half).where("pos between chrst and chrend").select("region_id", "chr", "chrst", "chrend", "pos", "rho")


def tile_regions(df: DataFrame, key: str, size: str, width: int = 3000) -> DataFrame:
    """Fixed tiling: key, chrst, chrend."""
    starts = df.where(F.col(size) >= 1).select(key, F.col(size).alias("__size"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(size).cast("long"), F.lit(width).cast("long"))).alias("chrst"))
    return starts.select(key, "chrst", F.least(F.col("chrst") + width - 1, F.col("__size")).alias("chrend"))


def balanced_split(df: DataFrame, key: str, start: str, end: str, max_size: int = 351) -> DataFrame:
    """key, k, sub_start, sub_end: k pieces as equal as can be; neighbours share an endpoint."""
    size = F.col(end) - F.col(start) + 1
    n = F.ceil(size / max_size)
    base, more = F.floor(size / n), size % n
    at = lambda k: F.col(start) - 1 + base * k + F.least(more, k)
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    k = F.col("k")
    return rows.select(key, "k", F.when(k == 1, F.col(start)).otherwise(at(k - 1)).alias("sub_start"), at(k).alias("sub_end"))


def assign_pieces(sites: DataFrame, start: Column, end: Column, max_size: int = 351) -> DataFrame:
    """Adds k: the piece of each site by arithmetic, no join. Half open; the last piece takes the rest."""
    size = end - start + 1
    n = F.ceil(size / max_size)
    base, more = F.floor(size / n), size % n
    # a site at the bound b_i = start - 1 + sum of lengths belongs to the next piece
    off = F.col("pos") - (start - 1)
    long = more * (base + 1)
    k = F.when(off < long, F.floor(off / (base + 1))).otherwise(more + F.floor((off - long) / base))
    return sites.withColumn("k", (F.least(k, n - 1) + 1).cast("int"))


def _group_ends(pos: np.ndarray, min_dist: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sites in order, the first and the last one of its group (row numbers)."""
    n = len(pos)
    new = np.ones(n, bool)
    new[1:] = np.diff(pos) > min_dist
    ends = np.append(np.flatnonzero(new)[1:], n) - 1
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)), ends[np.cumsum(new) - 1]


def _edges(e: np.ndarray, pos: np.ndarray, last: int | np.ndarray, groups: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where a region that would end at ``e`` ends, so that it cuts no group of the sites within 1000 bases."""
    n = len(pos)
    if not n:
        return e
    first, behind = groups
    lo, hi = np.searchsorted(pos, e - 1000, "left"), np.searchsorted(pos, np.minimum(last, e + 1000), "right") - 1
    pad = np.where(hi > lo, 5, 0)
    # the first site whose padded end is not before e: of the groups that hold e the first is its
    j = np.maximum(np.searchsorted(pos, e - pad, "left"), lo)
    has = j <= hi
    j = np.minimum(j, n - 1)
    a = pos[np.minimum(np.maximum(first[j], lo), n - 1)] - pad
    b = pos[np.minimum(behind[j], np.maximum(hi, 0))] + pad
    return np.where(has & (a <= e), np.where(2 * e - a > b, b + 2, a - 1), e)


def _regions(begin: np.ndarray, entry: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, counts: np.ndarray, size: int, min_dist: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the regions of many blocks, one a row, entered in ``entry``; ``at``: the sites of all, ``counts`` a row.

    Blocks lie on one line, too far apart for groups and windows to meet, and all make a step at a time: the
    work is that of the bounds, not of the characters.
    """
    n = len(begin)
    shift = np.arange(n) * (block + 8192 + min_dist) - begin
    pos = np.sort(at + np.repeat(shift, counts))
    groups, until, last = _group_ends(pos, min_dist), begin + block + shift, last + shift
    e, on, out = np.maximum(first + size - 1, begin + entry) + shift, np.arange(n), []
    while len(on):
        over = e[on] >= last[on]
        done = on[over]  # what is left, here or in no block of its own
        done = done[e[done] - size + 1 < last[done]]
        out.append((done, e[done] - size + 1, last[done]))
        on = on[~over]
        on = on[e[on] < until[on]]
        bound = _edges(e[on], pos, last[on], groups)
        out.append((on, e[on] - size + 1, bound))
        e[on] = bound + size
    row, start, end = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
    return row, start - shift[row], end - shift[row]


def chromosome_partition(sites: DataFrame, sizes: DataFrame, size: int = 3000, min_dist: int = 10, block: int = scans.BLOCK) -> DataFrame:
    """chr, chrst, chrend: ~``size`` regions whose bounds don't cut a group.

    ``sites``: chr, pos; ``sizes``: chr, first, last. Each bound depends on the one before, but only by
    where it lies. So each block of a chromosome tabulates in which place of the next one the walk goes on,
    for every place where it may come in; tables are composed (``scans.entries``), then all blocks walk
    their own bounds at once. A chromosome of one block is walked right away. Sites are needed within 1000 bases.
    """
    if size <= 1010:
        raise ValueError("regions must be longer than 1010 bases, so that bounds move on")
    reach = size + 1010  # a bound moves by less
    ship(sites.sparkSession)
    b = lambda x: F.floor(x / block)
    ends = sizes.select("chr", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).where("first < last")
    all_blocks = ends.withColumn("block", F.explode(F.sequence(b(F.col("first") + size - 1), F.greatest(b(F.col("first") + size - 1), b(F.col("last"))))))
    near = sites.where("pos is not null").select("chr", "pos", F.explode(F.array_distinct(F.array(b(F.col("pos") - 1011), b(F.col("pos") + 1011), b(F.col("pos"))))).alias("block"))
    packed = near.groupBy("chr", "block").agg(F.collect_list("pos").alias("at"))
    blocks = settled(all_blocks.join(packed, ["chr", "block"], "left"))

    def steps(row: dict, e: np.ndarray) -> np.ndarray:
        pos = np.sort(np.asarray(row["at"] or [], np.int64))
        return _edges(e, pos, row["last"], _group_ends(pos, min_dist))

    def table(row: dict) -> Iterator[dict]:
        begin = row["block"] * block
        to = steps(row, np.arange(begin, begin + block)) + size  # the next place to end at
        opens = row["first"] + size - 1
        e = np.full(reach, opens) if opens >= begin else np.arange(begin, begin + reach)  # a chromosome's first block has one way in
        while (inside := (e < begin + block) & (e < row["last"])).any():
            e[inside] = to[e[inside] - begin]
        yield {"chr": row["chr"], "block": row["block"], "f": np.where(e >= row["last"], -1, e - begin - block).tolist()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = x.column("at")
            number = lambda k: x.column(k).to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
            row, start, end = _regions(number("block") * block, number("entry"), number("first"), number("last"), at.flatten().to_numpy(zero_copy_only=False), counts, size, min_dist, block)
            yield pa.RecordBatch.from_arrays([x.column("chr").take(pa.array(row)), pa.array(start), pa.array(end)], ["chr", "chrst", "chrend"])

    one = F.col("block") == b(F.col("first") + size - 1)
    out = "chr string, chrst long, chrend long"
    cut = F.col("first") + size - 1 < b(F.col("last")) * block  # more blocks than the first
    lone = blocks.where(one & ~cut).withColumn("entry", F.lit(0).cast("long")).mapInArrow(walk, out)
    many = blocks.where(cut)
    most = ends.agg(F.max(b(F.col("last")) - b(F.col("first")))).first()[0] or 0
    if most < 1:
        return lone
    tables = settled(scans.walked(many, "chr string, block long, f array<int>", table))
    starts = many.where(one).select("chr", "block", F.lit(0).cast("long").alias("entry"))
    entered = scans.entries(tables, starts, "chr", int(most) + 2).where("entry >= 0")
    return lone.unionByName(many.join(entered, ["chr", "block"]).mapInArrow(walk, out))


def subregion_table(regions: DataFrame, sites: DataFrame, max_size: int = 350, min_sites: int = 10) -> DataFrame:
    """region_id, k, size, n_cpg of the pieces of regions with at least ``min_sites`` sites.

    ``regions``: region_id, chrst, chrend; ``sites``: region_id, pos. A site on a bound belongs to
    the next piece; empty pieces have 0.
    """
    full = sites.join(regions, "region_id")
    k = assign_pieces(full, F.col("chrst"), F.col("chrend"), max_size).groupBy("region_id", "k").agg(F.count(F.lit(1)).alias("n"))
    enough = k.groupBy("region_id").agg(F.sum("n").alias("all")).where(F.col("all") >= min_sites).select("region_id")
    pieces = balanced_split(regions.join(enough, "region_id", "left_semi"), "region_id", "chrst", "chrend", max_size).withColumn("k", F.col("k").cast("int"))
    return pieces.join(k, ["region_id", "k"], "left").select("region_id", "k", (F.col("sub_end") - F.col("sub_start")).alias("size"), F.coalesce("n", F.lit(0)).cast("long").alias("n_cpg"))


def region_info(sites: DataFrame) -> DataFrame:
    """region_id, pos, rho, d of every site, d 0 at a region's last: ``sites`` has region_id, pos, rho."""
    return site_distances(sites, "region_id", None).select("region_id", "pos", "rho", F.coalesce("d_next", F.lit(0)).cast("long").alias("d"))


def interval_of(points: DataFrame, intervals: DataFrame, key: str, pos: str, i0: str, i1: str, place: str, width: int = 4096) -> DataFrame:
    """``points`` with the interval's ``place`` that holds each, -1 where none does; the first of several."""
    hit = overlap_join(points, intervals.select(key, i0, i1, F.col(place).alias("__place")), key, pos, pos, i0, i1, width)
    first = hit.groupBy(key, pos).agg(F.min("__place").alias("__place"))
    return points.join(first, [key, pos], "left").withColumn(place, F.coalesce("__place", F.lit(-1))).drop("__place")


def region_table(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """chr, chrst, chrend, n_cpg, n_groups of regions that have groups (a group counts where it begins)."""
    block = 4096
    r = regions.withColumn("blk", F.explode(F.sequence(F.floor(F.col("chrst") / block), F.floor(F.col("chrend") / block))))
    g = groups.withColumn("blk", F.floor(F.col("first_pos") / block))
    hit = g.join(r, ["chr", "blk"]).where("first_pos between chrst and chrend")
    return hit.groupBy("chr", "chrst", "chrend").agg(F.sum("n_cpg").alias("n_cpg"), F.count(F.lit(1)).alias("n_groups"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """bin 1..bins, n: zero bins included; only non-empty bins are shuffled."""
    counts = df.select(value.cast("int").alias("bin")).where(F.col("bin").between(1, bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    full = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return full.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


#: Bins of a level are this many times wider than those of the level below.
NEST, LEVELS = 8, 8


def _level(length: Column, width: int) -> Column:
    """The least level (from 0) whose bins are no shorter than ``length``; the top one for what is longer than all."""
    out = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        out = F.when(length <= width * NEST**i, F.lit(i)).otherwise(out)
    return out


def overlap_join(points: DataFrame, intervals: DataFrame, key: str, p0: str, p1: str, i0: str, i1: str, width: int) -> DataFrame:
    """Interval overlap [p0, p1] x [i0, i1] per key by an equi-join on nested bins, ``width`` at the finest level.

    A row's level is the first whose bins are no shorter than it, so it touches at most two bins there (but
    for rows longer than a bin of the top level). A pair meets at the level of its longer row, in the first bin
    that both touch, so none comes twice. Intervals, the fewer side, are dealt to their level and to all above it;
    points to those levels that intervals have, a row of at most ``LEVELS`` numbers: rows don't grow with lengths.
    Null ends match nothing.
    """
    widths = F.array(*[F.lit(width * NEST**i).cast("long") for i in range(LEVELS)])
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.get(widths, F.col("__lvl"))), F.floor(F.col(b) / F.get(widths, F.col("__lvl")))))
    length = lambda a, b: F.col(b) - F.col(a) + 1
    own = intervals.where(F.col(i0).isNotNull() & F.col(i1).isNotNull()).withColumn("__li", _level(length(i0, i1), width))
    there = own.select(F.collect_set("__li").alias("l")).scalar()
    left = points.where(F.col(p0).isNotNull() & F.col(p1).isNotNull()).withColumns({"__lp": _level(length(p0, p1), width), "__there": there})
    above = F.filter("__there", lambda i: i >= F.col("__lp"))
    at = F.when(F.exists("__there", lambda i: i < F.col("__lp")), F.array_union(F.array("__lp"), above)).otherwise(above)
    left = left.withColumn("__lvl", F.explode(at)).drop("__there").withColumn("__blk", bins(p0, p1))
    right = own.withColumn("__lvl", F.explode(F.sequence(F.col("__li"), F.lit(LEVELS - 1)))).withColumn("__blk", bins(i0, i1))
    hit = left.join(right, [key, "__lvl", "__blk"]).where((F.col(p0) <= F.col(i1)) & (F.col(p1) >= F.col(i0)) & (F.col("__lvl") == F.greatest("__lp", "__li")))
    return hit.where(F.col("__blk") == F.floor(F.greatest(F.col(p0), F.col(i0)) / F.get(widths, F.col("__lvl")))).drop("__blk", "__lvl", "__lp", "__li")
