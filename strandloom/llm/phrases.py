"""Operator 12, phrase collocations: merged count-min sketches, an exact second pass, scores, subsumption.

The first pass counts hashes of all phrases of one to three words in count-min sketches: two rows of
one-byte cells that stop at 255, as only the threshold matters. Each slice of texts sends its cells in
blocks; blocks are added up by Spark, and of the sum only one bit a cell is broadcast: whether it
reaches the threshold. A sketch never counts too little, so a phrase with a cell below the threshold
is rare for sure. The second pass counts the others exactly, by their words, and drops those that
the sketch held to be frequent by mistake. So the sketch's size decides how much is shuffled, never
what comes out. It grows with the texts up to ``MAX_CELLS``; beyond, more rare phrases pass it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import scratch
from strandloom.llm.words import _ODD, hash_words, mix, slices

#: Least occurrences, longest phrase, phrases a language, share (in %) of a longer phrase that subsumes.
LEAST, LONGEST, TOP, SUBSUMED = 10, 3, 2000, 50
#: Rows of the sketch, and cells of a row at most: 2 * 2**28 bits are 64 MB to broadcast.
ROWS, MAX_CELLS = 2, 1 << 28
#: Cells of a block (one unsigned 16-bit place in it).
BLOCK = 1 << 16
#: Characters of text a cell of a row stands for, so that few rare phrases share one.
CHARS_PER_CELL = 6
#: Rows that a join's key is dealt to, as a common word is part of many phrases.
SALTS = 16

_SIZES = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_BITS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bits", T.BinaryType())])
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")


class Slice:
    """Words of some texts as codes, with the lengths of what can follow each inside its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), "[.,;:!?\n\x0b\x0c\r]+", " \n ")
        parts = pc.split_pattern(pc.ascii_trim(pc.replace_substring_regex(marked, "[ \t]+", " "), " "), " ")
        n = np.asarray(pc.list_value_length(parts), np.int64)
        coded = parts.flatten().dictionary_encode()
        self.words, codes = coded.dictionary, np.asarray(coded.indices, np.int64)
        lang = langs.dictionary_encode()
        self.langs, self.lang = lang.dictionary, np.repeat(np.asarray(lang.indices, np.int64), n)
        text = np.repeat(np.arange(len(n)), n)
        names = self.words.to_pylist()
        stop = np.fromiter((w in ("\n", "") for w in names), bool, len(names))
        out = stop[codes] if len(codes) else np.zeros(0, bool)
        # a piece ends where a mark stands or a text ends
        piece = np.cumsum(out) + text
        keep = ~out
        self.codes, self.lang, self.piece = codes[keep], self.lang[keep], piece[keep]
        self.hashes = hash_words(self.words)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all phrases of ``k`` words; the hash is that of the language too."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :])
        h = mix(hash_words(self.langs) + np.uint64(k))[self.lang[at]]
        for j in range(k):
            h = mix(h * _ODD + self.hashes[self.codes[at + j]])
        return at, h


def cells_of(h: np.ndarray, width: int, row: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; rows lie behind one another."""
    b = np.uint64(64 - (width.bit_length() - 1))
    return ((mix(h ^ _ODD) if row else h) >> b).astype(np.int64) + row * width


def sketch_width(docs: DataFrame, max_cells: int = MAX_CELLS) -> int:
    """Cells of a row: a power of two by the characters of all texts."""
    chars = _texts(docs).agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return min(max_cells, max(BLOCK, 1 << max(0, int(chars // CHARS_PER_CELL)).bit_length()))


def sketches(docs: DataFrame, width: int, longest: int = LONGEST) -> DataFrame:
    """block, places, counts: the cells of the sketch that a slice of texts fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                s = Slice(b.column(0)[lo:hi], b.column(1)[lo:hi])
                h, n = np.unique(np.concatenate([s.grams(k)[1] for k in range(1, longest + 1)]), return_counts=True)
                n = np.minimum(n, 255).astype(np.uint8)
                for row in range(ROWS):
                    cells = cells_of(h, width, row)
                    block = (cells // BLOCK).astype(np.uint16)
                    order = np.argsort(block, kind="stable")  # a radix sort
                    place, count = (cells[order] % BLOCK).astype("<u2"), n[order]
                    names, first = np.unique(block[order], return_index=True)
                    ends = np.append(first[1:], len(order))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names.astype(np.int32)), *[pa.array([x[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for x in (place, count)]], _SIZES.names
                    )

    return _texts(docs).mapInArrow(run, _SIZES)


def frequent_cells(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """block, bits: which cells of the added sketches reach ``least``. A partition holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], _BITS.names)

        for b in batches:
            for block, places, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(BLOCK, np.int64)
                total += np.bincount(np.frombuffer(places.as_buffer(), "<u2"), np.frombuffer(counts.as_buffer(), np.uint8), BLOCK).astype(np.int64)
        if now is not None:
            yield done()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, _BITS)


def survivors(docs: DataFrame, bits, width: int, longest: int = LONGEST) -> DataFrame:
    """lang, k, phrase, f: counts in slices of texts of the phrases that the sketch lets pass; k 0: of all words.

    ``bits``: a broadcast array of a bit a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in batches:
            for lo, hi in slices(b.column(1)):
                s = Slice(b.column(0)[lo:hi], b.column(1)[lo:hi])
                names = s.langs
                n = np.bincount(s.lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n)), pa.array(n.astype(np.int64))], _COUNTS.names)
                for k in range(1, longest + 1):
                    at, h = s.grams(k)
                    for row in range(ROWS):
                        cells = cells_of(h, width, row)
                        may = ((held[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
                        at, h = at[may], h[may]
                    _, first, n = np.unique(h, return_index=True, return_counts=True)
                    if not len(first):
                        continue
                    at = at[first]
                    text = pc.binary_join_element_wise(*[s.words.take(pa.array(s.codes[at + j])) for j in range(k)], " ")
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(s.lang[at])), pa.array(np.full(len(at), k, np.int32)), text, pa.array(n.astype(np.int64))], _COUNTS.names)

    return _texts(docs).mapInArrow(run, _COUNTS)


def phrase_counts(docs: DataFrame, least: int = LEAST, max_cells: int = MAX_CELLS) -> DataFrame:
    """lang, k, phrase, f: exact counts of all phrases of 1 to 3 words with f >= ``least``; k 0: all words of a language."""
    spark = docs.sparkSession
    width = sketch_width(docs, max_cells)
    held = np.zeros(ROWS * width // 8, np.uint8)
    # a bit a cell, ROWS * MAX_CELLS at most; written first, as the driver reads one partition after the other
    for r in scratch(frequent_cells(sketches(docs, width), least), "cells").toLocalIterator():
        held[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    bits = spark.sparkContext.broadcast(held)
    found = survivors(docs, bits, width).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return found.where((F.col("f") >= least) | (F.col("k") == 0))


def scored(counts: DataFrame, salts: int = SALTS) -> DataFrame:
    """lang, phrase, k, a, l, r, score: candidates of 2 and 3 words by their lowest-scoring cut.

    A part of a phrase occurs at least as often, so it is among the counts too. Numbers are decimals
    of 38 digits until the score, so products are exact up to a = 10**16.
    """
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"), F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int").alias("salt"))
    cut = lambda i: F.struct(F.lit(i).alias("cut"), F.concat_ws(" ", F.slice("w", 1, i)).alias("left"), F.concat_ws(" ", F.slice("w", i + 1, LONGEST)).alias("right"))
    cuts = phrases.select("lang", "phrase", "k", "a", "salt", F.explode(F.when(F.col("k") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c")).select("lang", "phrase", "k", "a", "salt", "c.*")
    known = counts.where("k >= 1 and k < 3").select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    side = lambda name, f: known.select("lang", "salt", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("left", "l"), ["lang", "salt", "left"]).join(side("right", "r"), ["lang", "salt", "right"])
    top = (F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(20,0)")).cast("decimal(25,0)") * F.col("a").cast("decimal(20,0)")
    both = both.withColumns({"top": top.cast("decimal(38,0)"), "bottom": (F.col("l").cast("decimal(20,0)") * F.col("r").cast("decimal(20,0)")).cast("decimal(38,0)")})
    both = both.withColumn("score", F.expr("top div bottom").cast("long"))
    low = both.groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "k", "a", "low.l", "low.r", "low.score")


def unsubsumed(candidates: DataFrame, counts: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """Candidates without those that lie in a longer phrase with at least ``share`` % of their count."""
    w = F.split("phrase", " ", -1)
    inside = F.array(F.concat_ws(" ", F.slice(w, 1, 2)), F.concat_ws(" ", F.slice(w, 2, 2)))
    longer = counts.where("k = 3").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = candidates.join(longer, ["lang", "phrase"], "left")
    return held.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SUBSUMED, max_cells: int = MAX_CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    ``docs``: text, lang (null: ``und``). Letters A to Z are lower-cased; ``.,;:!?`` and line ends cut
    texts into pieces, spaces and tabs cut those into words. A phrase lies in one piece and has at
    least ``least`` occurrences in its language, overlapping ones included. Ties go to the more
    frequent phrase, then to the lesser bytes.

    Null and empty texts have no words; texts are taken whole, whatever their length; repeated rows
    count again; other columns are ignored; a language without phrases, or an empty table, has no row.
    """
    counts = scratch(phrase_counts(docs, least, max_cells), "phrases")
    left = unsubsumed(scored(counts), counts, share)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the best of each share of a language first, so that no task gets a whole language
    dealt = left.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("place", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

