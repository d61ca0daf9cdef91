"""Operator 3, quality rules: cutoffs chosen on labelled holdouts by exact binomial bounds.

DataFrame functions only. Every measure of a text is computed inside its row, so documents are
never shuffled; only labelled rows' measures (a few numbers each) are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import let, scratch

SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure`` reaches a cutoff; ``grid`` lists cutoffs from mild to strict."""

    measure: str
    grid: tuple[float, ...]


#: Shares and rates that grow with junk; grids are fixed before any label is seen.
RULES = (
    Rule("symbol_rate", (0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03)),
    Rule("dup_line_rate", (0.90, 0.75, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20)),
    Rule("repeat_rate", (0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08)),
    Rule("long_word_rate", (20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
)
#: At most this share of good documents may be rejected in a stratum, by all rules together ...
ALPHA = 0.01
#: ... with this probability of any wrong promise over all strata, rules and cutoffs.
DELTA = 0.05


def measures(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to ``docs``.

    n_repeat_words: words inside ``window``-word windows that occur twice or more in the text.
    Windows are compared by 64-bit hashes built from word hashes; a text whose windows are all
    distinct (the usual case) is settled by one array_distinct, else (hash, place) pairs are
    sorted and neighbours compared: n log n in the text's words. Null texts count as empty.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def repeats(h: Column) -> Column:
        n = F.size(h) - (window - 1)

        def of(wins: Column) -> Column:
            pairs = F.sort_array(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def places(p: Column) -> Column:
                last = F.size(p) - 1
                twice = F.filter(
                    F.transform(p, lambda x, i: F.when((F.get(p, i - 1).h == x.h) | ((i < last) & (F.get(p, i + 1).h == x.h)), x.i)),
                    lambda x: x.isNotNull(),
                )
                # overlapping windows share words: each adds what lies before the next one's start
                return let(
                    F.sort_array(twice),
                    lambda s: F.aggregate(
                        F.transform(s, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - x, F.lit(window))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
                    ),
                )

            return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(let(pairs, places))

        # F.slice takes 1-based starts
        wins = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, window)))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(wins, of))

    packed = let(
        hashed,
        lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeats(h).alias("n_repeat_words")),
    )
    lined = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.withColumns(
        {
            "__m": packed,
            "word_chars": F.length(F.translate(t, _SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": lined,
            "n_lines": F.size(lines).cast("long"),
        }
    )
    return out.withColumns({"n_words": F.col("__m.n_words"), "n_repeat_words": F.col("__m.n_repeat_words")}).drop("__m")


def with_rates(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_rate": F.col("n_repeat_words") / words,
            "long_word_rate": F.col("word_chars") / words,
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exactly summed in the log domain: one fold over 0..k."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), (n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc.t + F.log((n - i + 1) / i) + odds
        hi, lo = F.greatest(acc.s, t), F.least(acc.s, t)
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step).s


def choose_cutoffs(labelled: DataFrame, stratum: str, good: Column, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, measure, cutoff: the strictest cutoff per stratum and rule with a proven bound.

    A document goes if any rule rejects it, so each rule gets an equal part of ``alpha``: what
    the rules reject together is at most the sum of their parts. ``labelled`` holds the measures of labelled documents; only good ones bear on the risk. For
    each cutoff, k of n good documents would be rejected. The hypothesis "more than a = alpha /
    rules of all good documents are rejected" is discarded if P(Bin(n, a) <= k) <= delta / m: the
    Clopper-Pearson bound. Cutoffs of one rule are tested in a fixed order from mild to strict
    and testing stops at the first that isn't proven, so that m is only the number of
    (stratum, rule) pairs (Bonferroni): the family-wise error stays at most delta. A pair with
    too few labels proves nothing and gets no cutoff: its rule rejects nothing.
    """
    from pyspark.sql import Window as W

    entries = F.explode(F.array(*[F.struct(F.lit(r.measure).alias("measure"), F.col(r.measure).alias("value"), F.array(*map(F.lit, r.grid)).alias("grid")) for r in rules]))
    flat = labelled.where(good).select(F.col(stratum).alias("stratum"), entries.alias("e")).select("stratum", "e.measure", "e.value", F.posexplode("e.grid").alias("place", "cutoff"))
    counts = flat.groupBy("stratum", "measure", "place", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") >= F.col("cutoff")).cast("long")).alias("k"))
    # a row per stratum and cutoff from here on, whatever the corpus
    counts = scratch(counts, "cutoffs")
    m = max(1, counts.select("stratum").distinct().count() * len(rules))
    alpha /= len(rules)
    # a share of rejects at or over alpha can't be proven under it: the fold stays short
    hopeful = F.col("k") < F.col("n") * alpha
    tested = counts.withColumn("proven", F.when(hopeful, log_binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.log(F.lit(delta / m))).otherwise(False))
    milder = W.partitionBy("stratum", "measure").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    proven = tested.withColumn("all_proven", F.min("proven").over(milder)).where("all_proven")
    return proven.groupBy("stratum", "measure").agg(F.max_by("cutoff", "place").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Judge every document: measures, base_failed, kept, and the first rule that rejects it.

    ``labels``: doc_id, quality (1 good). Documents that fail the base rule are rejected first
    and don't count in the risk, which is about what the cutoffs add. A null stratum is a
    stratum of its own, null texts count as empty and fail the base rule; an empty table gives
    none. Repeated rows each give a row; label rows of one doc_id count once, and
    contradicting ones as good (the safe side).
    """
    names = [r.measure for r in rules]
    kept_cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *names]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    # read twice below (labelled rows, all rows): written once, without the texts
    judged = scratch(with_rates(measures(source)).select("stratum", *kept_cols), "quality")
    truth = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    labelled = judged.join(truth, "doc_id").where(~F.col("base_failed"))
    cutoffs = choose_cutoffs(labelled, "stratum", F.col("quality") == 1, rules, alpha, delta)
    # one row per stratum; strata may be many, so the join decides itself whether to broadcast
    per = cutoffs.groupBy(F.col("stratum").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("cutoffs"))
    hits = [F.when(F.col(n) >= F.element_at("cutoffs", n), F.lit(n)) for n in names]
    out = judged.join(per, judged.stratum == per.s, "left").withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*hits)))
    return out.select(*kept_cols[:7], F.col("rejected_by").isNull().alias("kept"), "rejected_by", *names)
