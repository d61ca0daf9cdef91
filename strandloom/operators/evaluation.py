"""Evaluation of calls and estimates: thresholds, curves, histograms, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.session import settled


def confusion(df: DataFrame, truth: Column, call: Column) -> DataFrame:
    """tp, fp, tn, fn and the four rates."""
    n = lambda c: F.sum(c.cast("long"))
    counts = df.select(truth.alias("t"), call.alias("c")).where("t is not null and c is not null").agg(n(F.col("t") & F.col("c")).alias("tp"), n(~F.col("t") & F.col("c")).alias("fp"), n(~F.col("t") & ~F.col("c")).alias("tn"), n(F.col("t") & ~F.col("c")).alias("fn"))
    r = lambda a, b: F.when(b > 0, a / b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", r(tp + tn, tp + fp + tn + fn).alias("accuracy"), r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("sensitivity"), r(tn, tn + fp).alias("specificity"))


def _passed(df: DataFrame, thresholds: list[float], passes, sums: list[Column]) -> DataFrame:
    """threshold and, for each, the sums of the rows that pass it; ``passes(v, t)`` on column v.

    Thresholds ascend. A row is counted by how many it passes, so no row is repeated a threshold;
    one row of at most thresholds + 1 counts is left.
    """
    grid = sorted(set(thresholds))
    n = F.size(F.filter(F.lit(grid), lambda t: passes(F.col("v"), t)))
    names = [f"c{i}" for i in range(len(sums))]
    counts = df.groupBy(n.alias("i")).agg(*[c.alias(k) for c, k in zip(sums, names, strict=True)])
    row = counts.agg(F.collect_list(F.struct("i", *names)).alias("c")).where(F.size("c") > 0)
    at = row.select("c", F.posexplode(F.lit(grid)).alias("place", "threshold"))
    total = lambda keep, k: F.aggregate(F.filter("c", keep), F.lit(0).cast("long"), lambda x, r: x + r[k])
    first = lambda r: r.i > F.col("place") if passes is _reaches else r.i >= len(grid) - F.col("place")
    return at.select("threshold", *[total(first, k).alias(k) for k in names], *[total(lambda r: F.lit(True), k).alias(f"all_{k}") for k in names])


def _reaches(v: Column, t: Column) -> Column:
    return v >= t


def _stays_under(v: Column, t: Column) -> Column:
    return v <= t


def by_threshold(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, p, n: score >= threshold counts as a call. One pass, map-side summed."""
    rows = df.select(truth.alias("t"), score.alias("v")).where("t is not null and v is not null")
    n = lambda c: F.sum(c.cast("long"))
    out = _passed(rows, thresholds, _reaches, [n(F.col("t")), n(~F.col("t"))])
    return out.select("threshold", F.col("c0").alias("tp"), F.col("c1").alias("fp"), F.col("all_c0").alias("p"), F.col("all_c1").alias("n"))


def call_at(score: Column, threshold: float) -> Column:
    """0 without a score, 1 from the threshold on, else -1."""
    return F.when(score.isNull(), 0).when(score >= threshold, 1).otherwise(-1)


def share_above(df: DataFrame, ratio: Column, right: Column, thresholds: list[float]) -> DataFrame:
    """threshold, share, accuracy of calls whose ratio is that far from 0; no call has accuracy 1."""
    rows = df.select(F.abs(ratio).alias("v"), right.alias("t")).where("v is not null")
    out = _passed(rows, thresholds, _reaches, [F.count(F.lit(1)), F.sum(F.coalesce(F.col("t"), F.lit(False)).cast("long"))])
    return out.select("threshold", (F.col("c0") / F.col("all_c0")).alias("share"), F.when(F.col("c0") > 0, F.col("c1") / F.col("c0")).otherwise(1.0).alias("accuracy"))


def adjacent_pairs(df: DataFrame, keys: list[str], order: list[str], ratio: Column, truth: Column, call: Column) -> DataFrame:
    """keys, ratio (the lesser one's distance from 0), truth, call (products) of neighbours in order."""
    by = W.partitionBy(*keys).orderBy(*order)
    rows = df.where(ratio.isNotNull()).select(*dict.fromkeys([*keys, *order]), F.abs(ratio).alias("r"), truth.alias("t"), call.alias("c"))
    two = rows.select("*", *[F.lead(x).over(by).alias(f"{x}2") for x in ("r", "t", "c")]).where("r2 is not null")
    return two.select(*keys, F.least("r", "r2").alias("ratio"), (F.col("t") * F.col("t2")).alias("truth"), (F.col("c") * F.col("c2")).alias("call"))


def accuracy_by_interval(df: DataFrame, value: Column, right: Column, low: float, width: float = 1.0, per: int = 1) -> DataFrame:
    """bin, n, share, accuracy of calls by interval of ``value``, and both summed up from the first bin.

    An interval is ``width / per`` wide: tenths are ``per=10``, as the double 0.1 is more than a tenth and
    puts 0.3 into the third interval. upto: the calls of this and earlier bins; running: their accuracy.
    """
    place = F.floor((value - low) * per / width).cast("long").alias("bin")
    b = df.select(place, right.alias("t")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t").cast("long")).alias("k"))
    w = W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row per interval
    every = F.sum("n").over(W.partitionBy(F.lit(0)))
    return b.select("bin", "n", (F.col("n") / every).alias("share"), (F.col("k") / F.col("n")).alias("accuracy"), F.sum("n").over(w).alias("upto"), (F.sum("k").over(w) / F.sum("n").over(w)).alias("running"))


def accuracy_curve(intervals: DataFrame, half: int) -> DataFrame:
    """step, share, accuracy: intervals -half..half folded around 0, from the surest inwards, both
    running: shares summed, accuracies weighted by them. Intervals without a call are right."""
    both = intervals.select(F.abs("bin").alias("far"), "share", "accuracy").where(F.col("far") <= half)
    full = both.sparkSession.range(half + 1).select(F.col("id").alias("far")).join(both.groupBy("far").agg(F.sum("share").alias("share"), F.sum("accuracy").alias("acc"), F.count(F.lit(1)).alias("seen")), "far", "left")
    sides = F.when(F.col("far") == 0, 1).otherwise(2)
    one = full.select("far", F.coalesce("share", F.lit(0.0)).alias("share"), ((F.coalesce("acc", F.lit(0.0)) + sides - F.coalesce("seen", F.lit(0))) / sides).alias("accuracy"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("far")).rowsBetween(W.unboundedPreceding, W.currentRow)  # half + 1 rows
    summed = one.select((half - F.col("far")).cast("int").alias("step"), F.col("far"), "accuracy", F.sum("share").over(w).alias("share"))
    return summed.select("step", "share", (F.sum(F.col("accuracy") * F.col("share")).over(w) / F.sum("share").over(w)).alias("accuracy"))


def pearson(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r"))


def errors(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, mae, mse of two estimates of the same."""
    return df.groupBy(*keys).agg(F.avg(F.abs(x - y)).alias("mae"), F.avg((x - y) * (x - y)).alias("mse"))


def paired_estimates(one: DataFrame, two: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, x, y of regions that both have, for scatter plots."""
    return one.select(*keys, F.col(value).alias("x")).join(two.select(*keys, F.col(value).alias("y")), keys)


def row_moments(df: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """keys, n, mean, std of each row's array: sample deviation, null below two values."""
    n = F.size(signal)
    mean = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(signal, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return df.where(n > 0).withColumn("mean", mean).select(*keys, n.alias("n"), "mean", F.when(n > 1, F.sqrt(square / (n - 1))).alias("std"))


def summary(df: DataFrame, keys: list[str], value: Column, cuts: list[float]) -> DataFrame:
    """keys, n, least, most, sum, and upto: for each cut the share of values that aren't over it."""
    part = [F.avg((F.col("v") <= c).cast("double")) for c in cuts]
    rows = df.select(*keys, value.alias("v")).where("v is not null")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("sum"), F.array(*part).alias("upto"))


def exponential_shares(theta: Column, edges: list[float]) -> Column:
    """Shares of an exponential distribution of mean ``theta`` between neighbouring edges."""
    return F.transform(F.lit(edges[:-1]), lambda a, i: F.exp(-a / theta) - F.exp(-F.get(F.lit(edges), i + 1) / theta))


def roc(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    return by_threshold(df, truth, score, thresholds).select("threshold", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))


def auc(points: DataFrame) -> DataFrame:
    """Left Riemann sum over rising fpr; ``points``: a row per threshold."""
    by = W.orderBy("fpr", "tpr")
    step = points.select("tpr", "fpr", F.lead("fpr").over(by).alias("next"))
    return step.agg(F.sum((F.col("next") - F.col("fpr")) * F.col("tpr")).alias("auc"))


def precision_recall(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    t = by_threshold(df, truth, score, thresholds)
    return t.where("tp + fp > 0 and p > 0").select("threshold", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 3).alias("precision"), F.round(F.col("tp") / F.col("p"), 3).alias("recall"))


def precision_drops(points: DataFrame) -> DataFrame:
    """recall, precision in order of recall, where the precision falls; ties in order of threshold."""
    by = W.partitionBy(F.lit(0)).orderBy("recall", "threshold")  # a row per threshold
    return points.withColumn("before", F.lag("precision").over(by)).where("precision < before").select("threshold", "recall", "precision")


def precision_recall_auc(points: DataFrame) -> DataFrame:
    """Left Riemann sum over rising recall of the points where the precision falls."""
    by = W.partitionBy(F.lit(0)).orderBy("recall", "threshold")
    step = precision_drops(points).select("precision", "recall", F.lead("recall").over(by).alias("next"))
    return step.agg(F.coalesce(F.sum((F.col("next") - F.col("recall")) * F.col("precision")), F.lit(0.0)).alias("auc"))


def pvalue_roc(df: DataFrame, truth: Column, p: Column, keys: tuple[str, ...] = (), steps: int = 1000) -> DataFrame:
    """keys, threshold, tpr, fpr of p <= threshold at 0, 1/steps, ..., 1; the rates' denominators are one larger.

    p are counted by the first threshold that they pass, so no row is repeated a threshold.
    """
    first = F.greatest(F.ceil(p * steps - 1e-9), F.lit(0)).cast("int")
    n = lambda c: F.sum(c.cast("long"))
    counts = df.where(p.isNotNull()).groupBy(*keys, first.alias("i")).agg(n(truth).alias("t"), n(~truth).alias("f"))
    grid = counts.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    by = W.partitionBy(*keys)  # steps + 1 rows a key
    upto = by.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    full = grid.join(counts, [*keys, "i"], "left").fillna(0, ["t", "f"])
    rate = lambda c: F.sum(c).over(upto) / (F.sum(c).over(by) + 1)
    return full.select(*keys, (F.col("i") / steps).alias("threshold"), rate("t").alias("tpr"), rate("f").alias("fpr"))


def histogram1d(df: DataFrame, value: Column, low: float, width: float) -> DataFrame:
    """bin, n, share."""
    counts = df.select(F.floor((value - low) / width).cast("long").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.select("bin", "n", (F.col("n") / total).alias("share"))


def histogram2d_log(df: DataFrame, x: Column, y: Column, bins: int) -> DataFrame:
    """bx, by, v: -log10 of the share of a bins x bins grid over [0, 1), one pseudo-count a cell."""
    place = lambda c: F.least(F.greatest(F.floor(c * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.select(place(x).alias("bx"), place(y).alias("by")).where("bx is not null and by is not null").groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins * bins).select((F.col("id") / bins).cast("int").alias("bx"), (F.col("id") % bins).cast("int").alias("by"))
    full = grid.join(counts, ["bx", "by"], "left").select("bx", "by", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return full.select("bx", "by", (-F.log10(F.col("n") / F.sum("n").over(W.partitionBy()))).alias("v"))


#: Ranges of a step of the search for ranks, and how many values a range may hold to be sorted in its row.
RANGES, SORTED = 64, 4096


def _same(keys: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def ranked_values(rows: DataFrame, keys: list[str], ranks: Column, sorted_at: int = SORTED) -> DataFrame:
    """keys, n, r, x: the value v of ``rows`` (keys, v; no null or NaN) at each rank r (from 0) of its key.

    ``ranks``: an array of longs made from the column n, the number of rows of a key. Ranks are narrowed by
    histograms: a sketch cuts the values between a rank's bounds into ``RANGES`` ranges of like numbers, these are
    counted exactly, and the least and greatest value of the range that holds the rank are the new bounds. Where a
    range holds at most ``sorted_at`` values they are sorted in its row. So a step shuffles sketches and counts, no
    values, and no task sees a key's values; how the values are distributed doesn't matter, and steps grow with the
    logarithm of their number. The bounds, a row a rank, lie in the shared folder.
    """
    # without keys the bounds are a row a rank, few by their making
    bounds = (lambda df: df) if keys else F.broadcast
    named = [*[f"r_{k}" for k in keys], "n"]
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    opened = ends.select(*[F.col(k).alias(f"r_{k}") for k in keys], "n", F.explode(F.array_distinct(ranks)).alias("r"), "lo", "hi")
    # under: values below lo; inside: values from lo to hi
    state = settled(opened.select(*named, "r", F.lit(0).cast("long").alias("under"), F.col("n").alias("inside"), "lo", "hi"))
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > sorted_at)
    marks = F.lit([i / RANGES for i in range(1, RANGES)])
    # the ends have ranges of their own, so that each step takes values away
    place = F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), RANGES + 1).otherwise(1 + F.size(F.filter("edges", lambda e: e < F.col("v"))))
    while state.where(wide).limit(1).count():
        inside = rows.join(bounds(state.where(wide)), _same(keys, "r_")).where("v between lo and hi")
        cut = settled(inside.groupBy(*named, "r", "under", "lo", "hi").agg(F.percentile_approx("v", marks, F.lit(20 * RANGES)).alias("edges")))
        inside = rows.join(bounds(cut), _same(keys, "r_")).where("v between lo and hi")
        counts = inside.groupBy(*named, "r", "under", place.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(W.partitionBy(*named, "r").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))  # at most RANGES + 2 rows
        found = counts.withColumn("below", F.col("under") + upto - F.col("c")).where("below <= r and r < below + c")
        state = settled(state.where(~wide).unionByName(found.select(*named, "r", F.col("below").alias("under"), F.col("c").alias("inside"), "lo", "hi")))
    few = state.where("lo < hi")
    held = rows.join(bounds(few), _same(keys, "r_")).where("v between lo and hi").groupBy(*named, "r", "under").agg(F.sort_array(F.collect_list("v")).alias("all"))
    x = F.get("all", (F.col("r") - F.col("under")).cast("int"))
    out = state.where("lo = hi").select(*named, "r", F.col("lo").alias("x")).unionByName(held.select(*named, "r", x.alias("x")))
    return out.select(*[F.col(f"r_{k}").alias(k) for k in keys], "n", "r", "x")


def box_statistics(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, q1, median, q3 (between ranks linear, exact), n; null and NaN don't count."""
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = df.select(*keys, value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    at = {q: F.lit(m) * (F.col("n") - 1) for q, m in marks.items()}
    ranks = F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)])
    full = ranked_values(rows, keys, ranks).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("x"))
    of = lambda r: F.element_at("x", r.cast("long"))
    quart = lambda r: of(F.floor(r)) + F.when(r > F.floor(r), (r - F.floor(r)) * (of(F.ceil(r)) - of(F.floor(r)))).otherwise(0.0)
    return full.select(*keys, *[quart(r).alias(q) for q, r in at.items()], "n")


def ecdf(df: DataFrame, value: Column, thresholds: list[float]) -> DataFrame:
    rows = df.select(value.alias("v")).where("v is not null")
    out = _passed(rows, thresholds, _stays_under, [F.count(F.lit(1))])
    return out.select("threshold", (F.col("c0") / F.col("all_c0")).alias("share"))


def exponential_fit(df: DataFrame, value: Column) -> DataFrame:
    """theta (the mean), n, log_lik, aic of an exponential distribution."""
    a = df.select(value.cast("double").alias("v")).where("v is not null").agg(F.avg("v").alias("theta"), F.count(F.lit(1)).alias("n"))
    ll = -F.col("n") * (F.log("theta") + 1)
    return a.select("theta", "n", ll.alias("log_lik"), (2 - 2 * ll).alias("aic"))
