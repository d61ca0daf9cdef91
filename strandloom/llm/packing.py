"""Operator 7, best-fit packing: swap-based local search on classes of equal bins.

How full bins get depends on lengths alone, and there are at most ``capacity`` different ones.
So the packing is decided on the histogram of piece lengths (at most ``capacity`` numbers,
whatever the corpus), where a class of equal bins is one pattern with a multiplicity: bins are
filled as lengths come, and exchanges between underfull ones do the rest. The
pieces are then dealt to the places of their length by distributed ranks.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import salted_rank, scratch
from strandloom.llm.words import slices

CAPACITY = 4096
Pattern = tuple[tuple[int, int], ...]  #: ((length, copies), ...), longest first


#: Letters of words that are looked up; all are single code points in composed form.
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿßğšžčćđ"
_SIGNS = ".,;:!?()[]{}\"#*$%&|<>=+/_@~^\\-"
_CAPITALS = "".join(c.upper() for c in _LETTERS if len(c.upper()) == 1 and c.upper().lower() == c)


#: Texts on which a table by words must give what the tokenizer gives.
_PROBES = ["Hello, World! 42 times\n\tand\r on", _LETTERS, " ".join(_LETTERS), _CAPITALS, _SIGNS, " ".join(_SIGNS), "it's (a) [b] {c} <d> e=f/g_h@i~j^k", "a1b22c333 3.14 1,000", "  lead  and trail  ", "Straße ÀÉÎ naïve déjà-vu"]


class WordTokenizer:
    """Ids of a tokenizers file, by distinct words.

    A tokenizer whose pre-tokenizer splits texts into words encodes each word alone, so the ids
    of a text are those of its words joined. A batch of texts is split into coded words by Arrow,
    distinct words are looked up in a table that the tokenizer itself fills, and the ids are
    gathered by numpy. A text with any character but those above goes to the tokenizer whole,
    so that ids always are the tokenizer's own.
    """

    _CLASS = "".join("\\" + c for c in _SIGNS)
    _ODD = rf"[^{_LETTERS}{_CAPITALS}0-9 \t\n\r{_CLASS}]|<\|(?:start|end)oftext\|>"
    _APART = rf"([{_CLASS}]+|[0-9])"

    def __init__(self, path: str, cache_size: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use all cores
        from tokenizers import Tokenizer, normalizers

        self.whole, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])  # the words below are normalised
        self.cache_size = cache_size
        self.cache: dict[str, bytes] = {"": b""}
        # a file that normalises or splits in another way is used on whole texts
        self.by_words = True
        self.by_words = self.encode_all(pa.array(_PROBES)) == [self._whole(t) for t in _PROBES]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return [self._whole(t) for t in texts.to_pylist()]
        odd = np.asarray(pc.match_substring_regex(texts, self._ODD))
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), self._APART, r" \1 "))
        coded = parts.flatten().dictionary_encode()
        vocabulary, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        known = self._known(vocabulary)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(known) else np.zeros(0, np.int64)
        n = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin[codes] - upto[:-1], n) + np.arange(upto[-1])]
        first = upto[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts), np.int64))])]
        out = [ids[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
        for i in np.flatnonzero(odd):
            out[i] = self._whole(texts[i].as_py())
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        cache = self.cache
        missing = [w for w in words if w not in cache]
        if len(cache) + len(missing) > self.cache_size:
            cache.clear()
            cache[""] = b""
            missing = [w for w in words if w]
        for w, e in zip(missing, self.words.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            cache[w] = array("I", e.ids).tobytes()
        out = [cache[w] for w in words]
        for w in missing:
            if len(w) > 64:  # the table stays small
                del cache[w]
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}

_PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit) per piece.

    Every document's ids and ``end_id``; only longer ones are cut, into ``capacity``-token
    pieces. Narrow. A null text is empty: one piece, the end id.
    """
    fields = _PIECES.fields if with_ids else _PIECES.fields[:-1]
    schema = T.StructType(fields)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        encode, end = _TOKENIZERS[tokenizer].encode_all, np.asarray([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            docs_ids = ((doc, ids + end) for lo, hi in slices(b.column(1), 4 << 20) for doc, ids in zip(b.column(0)[lo:hi].to_pylist(), encode(b.column(1)[lo:hi]), strict=True))
            for doc, ids in docs_ids:
                for n, at in enumerate(range(0, len(ids) // 4, capacity)):
                    raw = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, n, at, len(raw) // 4, zlib.crc32(raw), raw)[: len(fields)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def as_they_come(counts: dict[int, int], capacity: int = CAPACITY, order: int = 0) -> Counter:
    """Patterns of bins filled one after the other, lengths in an order that a hash gives.

    A bin is closed by the first length that it has no room for; a pattern is applied as often as
    the counts allow at once, so there are at most as many patterns as lengths.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    ring, bins = sorted(left, key=lambda k: ((k + 977 * order) * 0x9E3779B1 % 2**32 * (2 * order + 1) % 2**32, k)), Counter()
    while ring:
        taken = 1
        while taken < len(ring) and sum(ring[: taken + 1]) <= capacity:
            taken += 1
        own, ring = ring[:taken], ring[taken:]
        times = min(left[k] for k in own)
        bins[tuple((k, 1) for k in sorted(own, reverse=True))] += times
        for k in own:
            left[k] -= times
        ring += [k for k in own if left[k]]
    return bins


def _fill(p: Pattern) -> int:
    return sum(k * n for k, n in p)


def _change(p: Pattern, out: list[int], into: list[int]) -> Pattern:
    c = Counter(dict(p))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((k, n) for k, n in c.items() if n), reverse=True))


class Held:
    """Which patterns hold a size (a length, or the sum of two pieces), emptiest first, with the sizes in order."""

    def __init__(self, sizes_of) -> None:
        self.sizes_of, self.by, self.sizes = sizes_of, {}, []

    def add(self, p: Pattern, fill: int) -> None:
        for k in self.sizes_of(p):
            if k not in self.by:
                self.by[k] = []
                insort(self.sizes, k)
            insort(self.by[k], (fill, p))

    def drop(self, p: Pattern, fill: int) -> None:
        for k in self.sizes_of(p):
            self.by[k].pop(bisect_left(self.by[k], (fill, p)))
            if not self.by[k]:
                del self.by[k]
                self.sizes.pop(bisect_right(self.sizes, k) - 1)


def _lengths(p: Pattern) -> list[int]:
    return [k for k, _ in p]


def _two(p: Pattern) -> list[tuple[int, int]]:
    """The pairs of pieces that a pattern has."""
    return [(x, z) for i, (x, n) in enumerate(p) for z, _ in p[i:] if z != x or n > 1]


def _sums(p: Pattern) -> set[int]:
    return {x + z for x, z in _two(p)}


class Underfull:
    """The underfull bins by pattern, and what they hold."""

    def __init__(self, bins: Counter, capacity: int) -> None:
        self.capacity, self.bins = capacity, 0
        self.full: Counter[Pattern] = Counter()
        self.times: dict[Pattern, int] = {}
        self.fill: dict[Pattern, int] = {}
        self.one, self.two = Held(_lengths), None  # the second is made when it is needed
        self.heap: list[tuple[int, Pattern]] = []  # patterns to look at, fullest first
        for p, n in bins.items():
            self.put(p, n)

    def put(self, p: Pattern, n: int) -> None:
        if not p or not n:
            return
        self.bins += n
        fill = _fill(p)
        if fill == self.capacity:
            self.full[p] += n
        elif p in self.times:
            self.times[p] += n
        else:
            self.times[p], self.fill[p] = n, fill
            for held in (self.one, self.two):
                if held:
                    held.add(p, fill)
            heappush(self.heap, (-fill, p))

    def take(self, p: Pattern, n: int) -> None:
        self.bins -= n
        self.times[p] -= n
        if not self.times[p]:
            for held in (self.one, self.two):
                if held:
                    held.drop(p, self.fill[p])
            del self.times[p], self.fill[p]

    def giver(self, holders: list[tuple[int, Pattern]], a: Pattern) -> Pattern | None:
        """The emptiest holder that may give: squared fill grows if a bin draws from another that isn't fuller."""
        for fill, b in holders[:2]:  # the second, if the first is the bin itself
            if fill > self.fill[a]:
                return None
            if a != b or self.times[a] > 1:
                return b
        return None

    def _draw(self, a: Pattern, give: list[tuple[list[int], int]], held: Held) -> tuple[list[int], int, Pattern] | None:
        """(from a, size from b, b) of the exchange that fills ``a`` most.

        What a gives up asks for a size that is larger by the room at most; the largest of these,
        and of its holders the emptiest, is found by the sizes that there are, so the partners
        needn't be tried one by one.
        """
        room, best, how = self.capacity - self.fill[a], 0, None
        for out, size in give:
            i = bisect_right(held.sizes, size + room)
            while i and (y := held.sizes[i - 1]) - size > best:
                if giver := self.giver(held.by[y], a):
                    best, how = y - size, (out, y, giver)
                    if best == room:
                        return how
                i -= 1
        return how

    def one_of_theirs(self, a: Pattern) -> tuple[list[int], list[int], Pattern] | None:
        """A move, one-for-one or two-for-one exchange for one piece of b: (from a, from b, b)."""
        how = self._draw(a, [([], 0), *(([x], x) for x, _ in a), *(([x, z], x + z) for x, z in _two(a))], self.one)
        return how and (how[0], [how[1]], how[2])

    def two_of_theirs(self, a: Pattern) -> tuple[list[int], list[int], Pattern] | None:
        """Two pieces of b for two of a, for one or for none."""
        if self.two is None:
            self.two = Held(_sums)
            for p in self.times:
                self.two.add(p, self.fill[p])
        how = self._draw(a, [([], 0), *(([x], x) for x, _ in a), *(([x, z], x + z) for x, z in _two(a))], self.two)
        return how and (how[0], list(next(t for t in _two(how[2]) if sum(t) == how[1])), how[2])

    def apply(self, a: Pattern, out: list[int], into: list[int], b: Pattern) -> None:
        """Exchange in as many pairs of bins as both patterns have."""
        fill, n = self.fill[a], self.times[a] // 2 if a == b else min(self.times[a], self.times[b])
        self.take(a, n)
        self.take(b, n)
        self.put(_change(a, out, into), n)
        self.put(_change(b, into, out), n)
        if a in self.times:
            heappush(self.heap, (-fill, a))


def local_search(bins: Counter, capacity: int = CAPACITY) -> Counter:
    """Exchange pieces between underfull bins, raising squared fill, until bins empty.

    The fullest underfull bin draws from emptier ones: a move, a one-for-one or a two-for-one
    exchange. First those in which it gets one piece; where no bin has one left, those in which
    it gets two, at last also for two. Every exchange raises the sum of squared fills, so the search ends: when no
    packing has fewer bins, or when no pair of bins has an exchange. A bin that has lost all its
    pieces is gone. Nothing is capped; the work depends on the number of lengths, not on that of
    pieces.
    """
    under = Underfull(bins, capacity)
    lower = -(-sum(_fill(p) * n for p, n in bins.items()) // capacity)
    moved = True
    while moved and under.bins > lower:
        while under.heap and under.bins > lower:
            fill, a = heappop(under.heap)
            if under.fill.get(a) == -fill and (how := under.one_of_theirs(a)):
                under.apply(a, *how)
        moved = False
        for a in sorted(under.fill, key=lambda p: (-under.fill[p], p)):
            if under.bins <= lower:
                break
            if a in under.fill and (how := under.two_of_theirs(a)):
                under.apply(a, *how)
                moved = True
        under.heap = sorted((-f, p) for p, f in under.fill.items())
    return under.full + Counter(under.times)


#: A stuck search opens its underfull bins and one of so many patterns of full ones, so many times.
OPENED = 64
ROUNDS = 32


def _pieces(bins: Counter) -> Counter:
    counts: Counter[int] = Counter()
    for p, n in bins.items():
        for k, copies in p:
            counts[k] += copies * n
    return counts


def packed(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, opened: int = OPENED) -> Counter:
    """A local search, and more of them on a part of the bins as long as there are more than must be.

    Where no exchange is left, the underfull bins and those of one in ``opened`` patterns of full
    ones (by a hash, others each round) are filled anew, their lengths in another order, and
    searched. The outcome replaces them unless it has more bins. The rest are full, so once the
    part needs no more bins than it must, no packing of all has fewer. Ends there or after ``rounds``.
    """
    best = local_search(as_they_come(counts, capacity), capacity)
    lower = -(-sum(k * n for k, n in counts.items()) // capacity)
    for order in range(1, rounds):
        if sum(best.values()) <= lower:
            break
        part = Counter({p: n for p, n in best.items() if _fill(p) < capacity or zlib.crc32(repr((order, p)).encode()) % opened == 0})
        anew = local_search(as_they_come(_pieces(part), capacity, order), capacity)
        if sum(anew.values()) <= sum(part.values()):
            best = best - part + anew
    return best


def places(bins: Counter) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length, its ranges of ranks: (first rank, first sequence, bins, offset of the first copy, copies)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for p in sorted(bins, reverse=True):
        times, at = bins[p], 0
        for k, n in p:
            out.setdefault(k, []).append((used[k], sequence, times, at, n))
            used[k] += n * times
            at += n * k
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ...).

    The driver gets one count per length. Ranks within a length go over salted sub-groups, so a
    length that a third of all pieces have is no hot spot. Repeated rows get places of their own.
    """
    kept = scratch(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(packed(counts, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.int64) for k, v in table.items()})
    ranked = salted_rank(kept, ["length"], ["doc_id", "piece"], "rank")
    names = kept.columns
    extra = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                t = shared.value[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                within = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + within % row[:, 2]
                offset[own] = row[:, 3] + within // row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], extra.names)

    return ranked.mapInArrow(run, extra)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: a row per piece with its sequence and place in it.

    Texts are tokenised whole, whatever their length, and only cut between sequences. Null texts
    and empty ones are one piece, the end id; null ids and repeated rows are packed like others;
    other columns are ignored; an empty table gives none.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)
