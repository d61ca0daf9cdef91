"""Operator 5, benchmark decontamination: q-gram lemma filtering and banded alignment.

A text and a benchmark item are compared as case-folded code points, anything but letters and
digits being a space, so that places in the folded text are places in the text itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.words import slices

#: Length of the character q-grams.
Q = 12
#: Edits allowed per code point of a pattern.
RATE = 0.06
#: Items are matched in patterns of this many code points (an item that is shorter is one pattern).
PATTERN = 120
#: Quotations of items: parts of this many code points, one at every PART_STEP. A verbatim quote
#: of PART + PART_STEP - 1 code points holds a whole part.
PART, PART_STEP = 60, 15
#: Benchmark text that is indexed and broadcast at once; a larger benchmark goes in more blocks.
BLOCK_CHARS = 1_000_000
#: Bits of the table that tells whether any q-gram of the block has a hash.
_TABLE_BITS = 24
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Between texts that are searched together: longer than any edit budget, equal to nothing.
_GAP = np.full(64, 0xFFFFFFFE, np.uint32)


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> folded code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if not c.isalnum():
            table[i] = 32
        elif len(low := c.lower()) == 1:
            table[i] = ord(low)
    return table


def fold(text: str) -> np.ndarray:
    return _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def qgram_hashes(x: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram: Horner's rule on array slices, by doubling."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, width = x.astype(np.uint64), 1
    h *= _MUL
    h ^= h >> np.uint64(29)
    out, done = None, 0
    power = int(_MUL)
    while True:  # binary decomposition of q
        if q & width:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += width
        if 2 * width > q:
            break
        h = h[: len(h) - width] * np.uint64(power) + h[width:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        width *= 2
    out ^= out >> np.uint64(32)
    out *= _MUL
    return out ^ (out >> np.uint64(29))


def budget(length: int, q: int = Q, rate: float = RATE) -> tuple[int, int]:
    """(k, t) for a pattern: an occurrence with at most k edits shares at least t >= 1 q-grams.

    The q-gram lemma: t = length + 1 - q * (k + 1). k is ``rate`` of the length, less where a
    short pattern would have t < 1.
    """
    k = max(0, min(int(rate * length), (length + 1) // q - 1))
    while k and length + 1 - q * (k + 1) < 1:
        k -= 1
    return k, max(1, length + 1 - q * (k + 1))


class Index:
    """Q-grams of one block of a benchmark, with pattern and place, sorted by hash.

    ``part``: besides its patterns, an item that is longer is matched in parts of this length at
    every ``part_step`` (0: none; parts of fewer letters and digits than ``q`` tell nothing). An item of fewer letters and digits than ``q`` is matched
    exactly, as whole words.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = Q, pattern: int = PATTERN, rate: float = RATE, part: int = 0, part_step: int = PART_STEP) -> None:
        self.q = q
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by length, the items of each short text
        self.whole: dict[int, np.ndarray] = {}  # by item, its text
        self.items: list[tuple[int, int]] = []  # of each pattern: item, place in it
        self.texts: list[np.ndarray] = []
        for item, text in items:
            x = fold(text or "")
            if int((x != 32).sum()) < q:
                letters = np.flatnonzero(x != 32)
                if len(letters):  # too short for q-grams and edits
                    x = x[letters[0] : letters[-1] + 1]
                    self.short.setdefault(len(x), {}).setdefault(x.tobytes(), []).append(item)
                continue
            self.whole[item] = x
            n = max(1, -(-len(x) // pattern))
            width = -(-len(x) // n)
            starts = list(range(0, max(1, len(x) - width + 1), max(1, width // 2))) if n > 1 else [0]
            if starts[-1] + width < len(x):
                starts.append(len(x) - width)
            spans = [(s, width) for s in starts]
            if part and len(x) > part:
                spans += [(s, part) for s in [*range(0, len(x) - part, part_step), len(x) - part] if int((x[s : s + part] != 32).sum()) >= q]
            for s, size in dict.fromkeys(spans):
                self.items.append((item, s))
                self.texts.append(x[s : s + size])
        self.k, self.t = (np.asarray([budget(len(x), q, rate)[i] for x in self.texts], np.int64) for i in (0, 1))
        self.lengths = np.asarray([len(x) for x in self.texts], np.int64)
        grams = [qgram_hashes(x, q) for x in self.texts]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order].astype(np.int32), place[order].astype(np.int32)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def whole_words(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) of each exact occurrence of a short item that no letter or digit adjoins."""
        out = []
        bounds = np.concatenate([[True], (x == 32) | (x == _GAP[0]), [True]])  # bounds[i]: before x[i]
        for size, texts in self.short.items():
            h = qgram_hashes(x, size)
            own = np.concatenate([qgram_hashes(np.frombuffer(t, np.uint32), size) for t in texts])
            for s in np.flatnonzero(bounds[: len(h)] & bounds[size + 1 :] & np.isin(h, own)).tolist():
                out += [(item, s, s + size) for item in texts.get(x[s : s + size].tobytes(), [])]
        return out

    def regions(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """(pattern, first diagonal, last diagonal) of bands with enough shared q-grams.

        The q-grams that an occurrence shares lie on at most 2k + 1 neighbouring diagonals (k
        insertions, k deletions). Bands are twice as wide and overlap by half, so that one of
        them holds all of these.
        """
        h = qgram_hashes(x, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - _TABLE_BITS)])
        if not len(at):
            return []
        lo = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - lo
        if not n.any():
            return []
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner = self.owner[which].astype(np.int64)
        diagonal = np.repeat(at, n) - self.place[which] + (1 << 40)  # never negative
        step = 2 * self.k[owner] + 1
        band = diagonal // step
        # each diagonal is in two bands of 2 * step diagonals: band b has those of steps b and b + 1
        keys = np.stack([np.concatenate([owner, owner]), np.concatenate([band, band - 1])], axis=1)
        found, count = np.unique(keys, axis=0, return_counts=True)
        enough = count >= self.t[found[:, 0]]
        out = [(int(p), int(b) * int(2 * self.k[p] + 1) - (1 << 40)) for p, b in found[enough]]
        return [(p, d, d + 2 * int(2 * self.k[p] + 1) - 1) for p, d in out]


def banded_alignment(pattern: np.ndarray, x: np.ndarray, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the whole pattern on diagonals first..last.

    Edit distance with free ends in ``x``, confined to the band widened by k; None if it takes
    more than k edits. Of equal ones the leftmost end counts. Row by row over the band's
    columns; insertions run along a row as a running minimum.
    """
    lo, width, m = first - k, last - first + 2 * k + 1, len(pattern)
    big = m + width + k + 1
    cols = np.arange(width)
    text = np.full(m + width, 0xFFFFFFFF, np.uint32)  # outside of x nothing matches
    a, b = max(lo, 0), min(lo + m + width, len(x))
    if a < b:
        text[a - lo : b - lo] = x[a:b]
    exact = (np.lib.stride_tricks.sliding_window_view(text, m)[: width] == pattern).all(axis=1)
    if exact.any():  # no edits, no need of the table
        start = lo + int(exact.argmax())
        return 0, start, start + m
    at = lo + cols  # place in x before row 0
    score = np.where((at >= 0) & (at <= len(x)), 0, big)
    begin = at.copy()
    for i in range(m):
        # cell j of row i + 1 stands at place lo + i + 1 + j of x
        new = score + (text[i : i + width] != pattern[i])
        from_ = begin.copy()
        skip = np.append(score[1:], big) + 1  # pattern character left out
        better = skip < new
        new[better], from_[better] = skip[better], np.append(begin[1:], 0)[better]
        run = np.minimum.accumulate(new - cols) + cols  # characters of x put in
        if (run < new).any():
            source = np.maximum.accumulate(np.where(new - cols == np.minimum.accumulate(new - cols), cols, 0))
            from_ = np.where(run < new, from_[source], from_)
            new = run
        place = lo + i + 1 + cols
        new[(place < 0) | (place > len(x))] = big
        score, begin = new, from_
        if score.min() > k:
            return None
    j = int(score.argmin())
    return (int(score[j]), int(begin[j]), int(lo + m + j)) if score[j] <= k else None


def grown(item: np.ndarray, x: np.ndarray, drop: int = 6) -> int:
    """Code points that ``item`` and ``x`` go on to share: the best score of +1 / -2 before it drops."""
    n, at = min(len(item), len(x)), 0
    best, top, score = 0, 0, 0
    while at < n:  # in strides: most regions end soon
        same = item[at : at + 64][: n - at] == x[at : at + 64][: n - at]
        run = score + np.cumsum(np.where(same, 1, -2))
        tops = np.maximum.accumulate(np.maximum(run, top))
        stop = np.flatnonzero(tops - run > drop)
        run = run[: stop[0]] if len(stop) else run
        if len(run) and run.max() > top:
            top, best = int(run.max()), at + int(run.argmax()) + 1
        if len(stop):
            break
        score, at = int(run[-1]), at + len(run)
    return best


def find_regions(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, item, start, end, edits) of verified regions, merged per item.

    The texts are searched as one array, so that a batch costs a few array operations. Regions
    grow at both ends as long as the text goes on like the item.
    """
    folded = [y for t in texts for y in (fold(t), _GAP)]
    if not folded:
        return []
    x = np.concatenate(folded)
    sizes = np.asarray([len(y) for y in folded[::2]], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + len(_GAP))[:-1]])
    hits: dict[tuple[int, int], list[list[int]]] = {}
    for p, first, last in index.regions(x):
        if found := banded_alignment(index.texts[p], x, first, last, int(index.k[p])):
            edits, start, end = found
            row = int(np.searchsorted(begins, (start + end) // 2, "right")) - 1
            lo, hi = int(begins[row]), int(begins[row] + sizes[row])
            item, place = index.items[p]
            hits.setdefault((row, item), []).append([max(start, lo) - lo, min(end, hi) - lo, edits, place, place + len(index.texts[p])])
    for item, start, end in index.whole_words(x):
        row = int(np.searchsorted(begins, start, "right")) - 1
        hits.setdefault((row, item), []).append([start - int(begins[row]), end - int(begins[row]), 0, 0, 0])
    out = []
    for (row, item), spans in sorted(hits.items()):
        merged: list[list[int]] = []  # start, end, edits, and the places in the item that these stand for
        for s, e, edits, i, j in sorted(spans):
            if merged and s <= merged[-1][1]:
                top = merged[-1]
                top[2] = max(top[2], edits)
                if e > top[1]:
                    top[1], top[4] = e, j
            else:
                merged.append([s, e, edits, i, j])
        if (whole := index.whole.get(item)) is not None:
            own = x[int(begins[row]) : int(begins[row] + sizes[row])]
            for span in merged:
                span[0] -= grown(whole[: span[3]][::-1], own[: span[0]][::-1])
                span[1] += grown(whole[span[4] :], own[span[1] :])
        ends: list[list[int]] = []
        for s, e, edits, *_ in sorted(merged):
            if ends and s <= ends[-1][1]:
                ends[-1][1:] = [max(ends[-1][1], e), max(ends[-1][2], edits)]
            else:
                ends.append([s, e, edits])
        out += [(row, item, s, e, edits) for s, e, edits in ends]
    return out


_REGION = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "start", "end", "edits")])


#: The index that this worker has built last, by the number of its block.
_BUILT: dict[str, Index] = {}


def _index(number: str, items, how: tuple) -> Index:
    """The index of a broadcast block, built once in a worker, not once in a task."""
    if number not in _BUILT:
        _BUILT.clear()
        _BUILT[number] = Index(items.value, *how)
    return _BUILT[number]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded text, one at a time: the driver never holds more."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        if size + len(r["text"]) > block_chars and block:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def _shared(spark: SparkSession, items: list[tuple[int, str]]) -> tuple[str, object]:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(items)


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, pattern: int = PATTERN, block_chars: int = BLOCK_CHARS, part: int = PART, part_step: int = PART_STEP) -> DataFrame:
    """doc_id, item_id, start, end, edits: each region of a text that repeats benchmark text.

    Code points, end exclusive; a region is a run of matched patterns or parts of one item, each
    within its edit budget, grown to where the text stops being the item's, and ``edits`` the
    most of any pattern or part. Every verbatim quote of part + part_step - 1 code points of an
    item is found, unless its parts have fewer than ``q`` letters and digits. An item of fewer
    than ``q`` letters and digits counts where it occurs exactly, as whole words. Narrow: texts
    aren't shuffled. The benchmark (a stated query set) is read in blocks of ``block_chars``
    characters, each broadcast and indexed by itself; every block takes a pass over the documents.

    Texts are taken whole, whatever their length. Null and short texts have no region, null items
    neither; repeated rows each give theirs, rows with a null id too; other columns are ignored;
    empty tables give none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = docs.sparkSession.createDataFrame([], _REGION)
    for n, items in enumerate(_blocks(benchmark, block_chars)):
        found = _scan(source, *_shared(docs.sparkSession, items), (q, pattern, rate, part, part_step))
        out = found if not n else out.unionByName(found)
    return out


def _scan(source: DataFrame, number: str, items, how: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = _index(number, items, how)
            for lo, hi in slices(b.column(1), 2 << 20):
                ids = b.column(0)[lo:hi].to_pylist()
                rows = [(ids[row], *hit) for row, *hit in find_regions(b.column(1)[lo:hi].to_pylist(), index)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_REGION.names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _REGION.names)

    return source.mapInArrow(run, _REGION)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, pattern: int = PATTERN, block_chars: int = BLOCK_CHARS, part: int = PART, part_step: int = PART_STEP) -> DataFrame:
    """The rows of ``docs`` without any contaminated region, all columns kept.

    Narrow: rows are judged and filtered in place, so repeated rows and null ids are judged each
    by its own text; rows of null texts stay. A pass over what is left for each block of the benchmark.
    """

    def without(rows: DataFrame, number: str, items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index = _index(number, items, (q, pattern, rate, part, part_step))
                texts = b.column(b.schema.get_field_index("text"))
                for lo, hi in slices(texts, 2 << 20):
                    bad = {row for row, *_ in find_regions([t or "" for t in texts[lo:hi].to_pylist()], index)}
                    own = b.slice(lo, hi - lo)
                    yield own.filter(pa.array([i not in bad for i in range(hi - lo)])) if bad else own

        return rows.mapInArrow(run, rows.schema)

    for items in _blocks(benchmark, block_chars):
        docs = without(docs, *_shared(docs.sparkSession, items))
    return docs
