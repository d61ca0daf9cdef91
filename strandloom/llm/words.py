"""Words and shingles of a batch of texts as flat numpy arrays.

A word is a maximal run of letters, digits and underscores of the lower-cased text. A batch is
turned into one array of word codes with document offsets, so that everything after it is
vectorised over all documents of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Windows that are hashed together.
_CACHED = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, near inputs come far apart."""
    x = x ^ (x >> np.uint64(30))  # an array of its own; the rest in place
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash of each distinct word."""
    from pandas.util import hash_array

    return hash_array(np.asarray(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def slices(texts: pa.Array, max_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each (a longer single text is its own range)."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start, n = 0, len(texts)
    while start < n:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + max_bytes, side="right")))
        yield start, end
        start = end


def flat_words(texts: pa.Array, lower: bool = True, signs: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word of all texts in order, first word of each text + end).

    ``signs``: characters that count as letters.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.utf8_lower(texts) if lower else texts
    spaced = pc.utf8_trim(pc.replace_substring_regex(texts, rf"[^\pL\pN_{signs}]+", " "), " ")
    parts = pc.split_pattern(spaced, " ")
    n = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    flat = parts.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(spaced), 0))
    if empty.any():  # an empty text splits into one empty word
        flat = flat.filter(pa.array(np.repeat(~empty, n)))
        n = np.where(empty, 0, n)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), np.concatenate([[0], np.cumsum(n)])


def kgrams(hashes: np.ndarray, offsets: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word windows inside a document, first window of each document + end).

    ``short``: a document of 1 to k-1 words has one window, all its words.
    """
    n = np.diff(offsets)
    windows = np.maximum(n - k + 1, 0)
    lacking = np.flatnonzero((n > 0) & (n < k)) if short else np.zeros(0, np.int64)
    out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for at in range(0, len(out), _CACHED):  # all words of a window while they are at hand
        part = out[at : at + _CACHED]
        for j in range(k):
            part[:] = mix(part * _ODD + hashes[at + j : at + j + len(part)])
    owner_ok = np.ones(len(out), bool)
    if len(out):
        for j in range(1, k):  # a window that starts in the last k-1 words of a document crosses its end
            at = offsets[1:] - j
            owner_ok[at[(at >= offsets[:-1]) & (at < len(out)) & (at >= 0)]] = False
    kept = out[owner_ok]
    if not len(lacking):
        return kept, np.concatenate([[0], np.cumsum(windows)])
    first = np.concatenate([[0], np.cumsum(windows)])
    extra = []
    for i in lacking:
        x = np.full(1, np.uint64(n[i]))
        for h in hashes[offsets[i] : offsets[i + 1]]:
            x = mix(x * _ODD + h)
        extra.append(x[0])
    kept = np.insert(kept, first[lacking], np.asarray(extra, np.uint64))
    windows[lacking] = 1
    return kept, np.concatenate([[0], np.cumsum(windows)])
