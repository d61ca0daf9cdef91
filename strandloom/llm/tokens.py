"""Operator 1, token counts: greedy word-piece lengths by a longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LongestMatchCounter:
    """Counts greedy longest-match pieces of a word in one pass, without building them.

    Each node of the vocabulary's trie gets a failure link and the number of tokens popped when
    it is taken: greedy matching cuts its longest piece off the node's string, and the link
    leads to the node of what remains. So a word of n characters takes O(n) steps, whatever the
    longest piece. A character at which no piece matches counts as its UTF-8 bytes (byte
    fallback); such characters that occur inside pieces are nodes too, so that links never end.

    ``mark`` is put before each word: word-start pieces carry it, continuations don't.
    """

    def __init__(self, pieces: Iterable[str], mark: str = "", cache_size: int = 200_000) -> None:
        self.mark, self.cache_size = mark, cache_size
        weights = {p: 1 for p in pieces if p}
        for c in {c for p in weights for c in p}:
            weights.setdefault(c, _bytes(c))
        self.next: list[dict[str, int]] = [{}]
        weight = [0]
        for p, w in weights.items():
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                at = to
            weight[at] = w
        self.fail, self.popped = [0] * len(self.next), weight
        self._cache: dict[str, int] = {}
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:  # breadth first: the links of shorter strings are known
            below = []
            for u, c, v in level:
                if not weight[v]:
                    z, n = self.fail[u], self.popped[u]
                    while c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    self.fail[v], self.popped[v] = self.next[z][c], n
                below += [(v, d, w) for d, w in self.next[v].items()]
            level = below

    def count(self, word: str) -> int:
        """Tokens of mark + word; 0 for an empty word."""
        if not word:
            return 0
        nxt, fail, popped = self.next, self.fail, self.popped
        total = u = 0
        for c in self.mark + word:
            while (to := nxt[u].get(c)) is None and u:
                total += popped[u]
                u = fail[u]
            if to is None:
                total += _bytes(c)
            else:
                u = to
        while u:
            total += popped[u]
            u = fail[u]
        return total

    def count_text(self, text: str) -> int:
        """Tokens of all white-space separated words; counts of short words are kept, up to a bound."""
        cache, total = self._cache, 0
        for w in text.split():
            n = cache.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= 40:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


def _bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The plain pieces of a sentencepiece model (control, unknown and byte pieces aren't text)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


_COUNTERS: dict[tuple, LongestMatchCounter] = {}


def token_counts(docs: DataFrame, pieces: list[str], mark: str = "▁", text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text; null or blank texts count 0.

    Narrow: no shuffle. The vocabulary is broadcast: its size is that of the vocabulary file
    (32,000 pieces by default) whatever the corpus. Each worker builds the automaton once.
    Repeated rows each give a row; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((mark, pieces))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_tokens")])
    name = hash((mark, tuple(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[name] = LongestMatchCounter(shared.value[1], shared.value[0])
        counter = _COUNTERS[name]
        for b in batches:
            words, tokens = [], []
            for t in b.column(1):
                s = t.as_py() or ""
                words.append(len(s.split()))
                tokens.append(counter.count_text(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], list(schema.names))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def greedy_count(word: str, pieces: set[str], mark: str = "") -> int:
    """The same count by trying every length, for tests."""
    rest, total = (mark + word) if word else "", 0
    longest = max(map(len, pieces), default=1)
    while rest:
        for n in range(min(longest, len(rest)), 0, -1):
            if rest[:n] in pieces:
                total, rest = total + 1, rest[n:]
                break
        else:
            total, rest = total + _bytes(rest[0]), rest[1:]
    return total
