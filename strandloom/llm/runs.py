"""Operator 11, periodic runs of words: a Lempel-Ziv factorisation, Main's algorithm, copies.

A run is a stretch that repeats with some period and that no neighbour extends. The method of
Kolpakov and Kucherov finds all of a sequence in time near its length: a suffix automaton cuts the
sequence into factors, each the longest that occurred before; a run that touches the border of two
factors begins at most twice the one and once the other before it, so Main's extensions from that
border find it; a run strictly inside a factor is that of the factor's earlier occurrence.

Most texts repeat little. All words of a run open eight words that recur in it, so only stretches
of words in which each eight recur in the same stretch are searched. That is a proof, no sample:
what it leaves out holds no run of the length asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.words import hash_words, kgrams, slices

#: Least words of a run, and least periods in it.
MIN_WORDS, MIN_PERIODS = 24, 3

_SPACES = r"[\x20\x09-\x0D]+"


def first_ends(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of ``s``: steps of each state, and the first place where its words end."""
    steps: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                part = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = part
                    p = link[p]
                link[q] = link[new] = part
        last = new
    return steps, end


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence) of each factor; -1 for a letter that is new."""
    steps, end = first_ends(s)
    out, i = [], 0
    while i < len(s):
        state, k, before = 0, 0, -1
        while i + k < len(s):
            state = steps[state][s[i + k]]
            if end[state] >= i + k:  # its first end is this one
                break
            k += 1
            before = end[state] - k + 1
        out.append((i, max(k, 1), before if k else -1))
        i += max(k, 1)
    return out


def matches(s: list[int]) -> list[int]:
    """How much of its own beginning ``s`` has at each place (all of it at the first)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def border_runs(s: list[int], border: int, begin: int, end: int, min_words: int, min_periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repeats in ``s[begin:end]`` that touch ``border``; periods may be multiples.

    For each period the words behind the border are compared with those a period on, to the right
    and to the left; a repeat is there where both extensions make up the periods asked for.
    """
    t, v = s[begin:border], s[border:end]
    ahead = matches(v)
    back = matches(t[::-1])
    back_of = matches([*t[::-1], -1, *v[::-1], *t[::-1]])
    ahead_of = matches([*v, -1, *t, *v])
    nt, nv = len(t), len(v)
    for q in range(1, nv + 1):  # the first of the words compared begin at the border
        right = ahead[q] if q < nv else 0
        left = min(back_of[nt + 1 + nv - q], nt) if nt else 0
        if left + right + q >= min_words and left + right >= (min_periods - 1) * q:
            yield border - left, border + q + right, q
    for q in range(1, nt + 1):  # the last of them end there
        right = min(ahead_of[nv + 1 + nt - q], nv) if nv else 0
        left = back[q] if q < nt else 0
        if left + right + q >= min_words and left + right >= (min_periods - 1) * q:
            yield border - q - left, border + right, q


def find_runs(s: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, least period) of all runs of at least so many words and periods, by start, then period."""
    n = len(s)
    fs = factors(s)
    least: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int, int]] = []  # (start, end, period) by start

    def put(a: int, e: int, q: int) -> None:
        old = least.get((a, e))
        if old is None:
            insort(known, (a, e, q))
        elif q < old:
            del known[bisect_left(known, (a, e, old))]
            insort(known, (a, e, q))
        else:
            return
        least[a, e] = q

    for k in range(1, len(fs) + 1):
        border = fs[k][0] if k < len(fs) else n
        size = fs[k][1] if k < len(fs) else 0
        begin, end = max(0, border - 2 * fs[k - 1][1] - size), border + size
        for a, e, q in border_runs(s, border, begin, end, min_words, min_periods):
            if (e == end and e < n and s[e] == s[e - q]) or (a == begin and a > 0 and s[a - 1] == s[a - 1 + q]):
                continue  # goes on outside: found at the border that it reaches last
            put(a, e, q)
        if k < len(fs) and fs[k][2] >= 0 and size > min_words:
            shift, last = border - fs[k][2], fs[k][2] + size
            i = bisect_left(known, (fs[k][2] + 1,))
            while i < len(known) and known[i][0] < last - min_words:
                a, e, q = known[i]
                if e < last:  # strictly inside: its neighbours came along
                    put(a + shift, e + shift, q)
                i += 1
    return [(a, e - a, q) for a, e, q in sorted(known, key=lambda r: (r[0], r[2]))]


def repeating(gram: np.ndarray, begin: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of stretches whose every ``k`` words recur in the same stretch.

    ``gram``: a hash of each k words, ``begin``: those of each text. Stretches are narrowed until
    nothing more falls away or three times; what stays is searched.
    """
    part = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.arange(len(gram))
    for _ in range(3):
        if not len(at):
            return
        order = np.lexsort((gram[at], part))
        g, p = gram[at][order], part[order]
        same = (g[1:] == g[:-1]) & (p[1:] == p[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        left, p = at[twice], part[twice]
        if len(left) == len(at):
            break
        new = np.ones(len(left), bool)
        new[1:] = (np.diff(left) > 1) | (p[1:] != p[:-1])
        at, part = left, np.cumsum(new)
    text = np.searchsorted(begin, at, "right") - 1
    # stretches of the first round are whole texts
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    for i, j in zip(first, last, strict=True):
        yield int(text[i]), int(at[i] - begin[text[i]]), int(at[j] - begin[text[i]]) + k


def periodic_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """(first word, period) from which a text of ``n`` words is made to repeat; None where it isn't."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def flat_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word of all texts, first word of each text + end): runs of what is no ASCII space."""
    spaced = pc.ascii_trim(pc.replace_substring_regex(pc.fill_null(texts, ""), _SPACES, " "), " ")
    parts = pc.split_pattern(spaced, " ")
    n = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    flat, none = parts.flatten(), np.asarray(pc.equal(pc.binary_length(spaced), 0))
    if none.any():
        flat = flat.filter(pa.array(np.repeat(~none, n)))
        n = np.where(none, 0, n)
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), np.concatenate([[0], np.cumsum(n)])


_NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in _NUMBERS], T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_dropped", T.LongType())])


def best_run(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of most periods, exactly; of equal ones the first, then that of the least period."""
    best = found[0]
    for r in found[1:]:
        ahead, behind = r[1] * best[2], best[1] * r[2]
        if ahead > behind or (ahead == behind and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def periodic_runs(docs: DataFrame, tails: bool = False, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_runs, the run of most periods (start, length, period, exponent_milli), digests of all
    runs and of the text without its repeats, n_words, n_dropped.

    A word is what stands between ASCII spaces, tabs and line ends. A run is dropped but for its
    first period. ``tails``: texts are first made to repeat from ``periodic_tail`` on. ``min_words``
    must be at least 24 and ``min_periods`` at least 3: shorter runs need not have eight words that recur.

    A null or empty text has no word and no run; texts without a run have nulls for it. Texts are
    taken whole, whatever their length; rows that repeat a doc_id are rows of their own; a null
    doc_id has no tail; other columns are ignored; an empty table gives no row.
    """
    if min_words < MIN_WORDS or min_periods < MIN_PERIODS:
        raise ValueError(f"runs of at least {MIN_WORDS} words and {MIN_PERIODS} periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), 4 << 20):
                ids = b.column(0)[lo:hi]
                words, codes, at = flat_tokens(b.column(1)[lo:hi])
                if tails:
                    for i, d in enumerate(ids.to_pylist()):
                        tail = periodic_tail(d, int(at[i + 1] - at[i])) if d is not None else None
                        if tail:
                            a, p = tail
                            text = codes[at[i] : at[i + 1]]
                            text[a:] = text[a + np.arange(len(text) - a) % p]
                gram, begin = kgrams(hash_words(words)[codes], at, 8, short=False)
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for i, s, e in repeating(gram, begin, 8):
                    if e - s >= min_words:
                        found = find_runs(codes[at[i] + s : at[i] + e].tolist(), min_words, min_periods)
                        runs.setdefault(i, []).extend((a + s, n, q) for a, n, q in found)
                keep = np.ones(len(codes), bool)
                cols: list[list] = [[] for _ in _NUMBERS]
                digests = []
                for i in range(hi - lo):
                    found = runs.get(i, [])
                    for a, n, q in found:
                        keep[at[i] + a + q : at[i] + a + n] = False
                    a, n, q = best_run(found) if found else (None, None, None)
                    for c, v in zip(cols, (len(found), a, n, q, 1000 * n // q if found else None), strict=True):
                        c.append(v)
                    digests.append(_hex("".join(f"{a},{n},{q}\n" for a, n, q in found)))
                left = np.concatenate([[0], np.cumsum(keep)])[at]
                kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.take(pa.array(codes[keep])))
                collapsed = [_hex(t) for t in pc.binary_join(kept, " ").to_pylist()]
                sizes = np.diff(at)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols], pa.array(digests), pa.array(collapsed), pa.array(sizes), pa.array(sizes - np.diff(left))], _OUT.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)
