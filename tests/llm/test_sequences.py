"""Operators 11 to 13: runs against all stretches, phrases against plain counts, tokens against the library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import bytepairs, phrases, queries, runs

DOC = "doc_id long, text string, lang string, source string, n_chars long, f long, k int, block int, n_runs long, salt int"


def odd_rows() -> list[tuple]:
    r = random.Random(3)
    base = ["".join(r.choices("abcdef", k=r.randint(1, 4))) for _ in range(60)]
    texts = [None, "", " \n\t ", "one", " ".join(base), " ".join(base), "ab cd " * 40, "x " * 30_000, "y" * 50_000, "a b c, a b c. " * 30, "É é ß 日本語   a b <|endoftext|> it's", "tab\there\rand\x0bthere\x0cend", " ".join(base[:20] * 7 + base), "a.b;c:d!e?f a b", "\U0001f600 ퟿"]
    ids = list(range(1, len(texts) + 1))
    ids[1], ids[2], ids[-1] = None, 5, 5
    rows = [(i, t, ["en", None, "", "de"][j % 4], "s", 1, 2, 3, 4, 5, 6) for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return rows + [(100 + j, " ".join(base[j % 7 :] + base[: j % 5]), "en", "s", 1, 2, 3, 4, 5, 6) for j in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 11


def all_runs(s: list, min_words: int, min_periods: int) -> list[tuple[int, int, int]]:
    """Every period over the whole sequence; of one stretch the least."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(s) // min_periods + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_periods * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, e - a, q) for (a, e), q in out.items()), key=lambda x: (x[0], x[2]))


def test_factors_occur_before():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randrange(3) for _ in range(r.randint(1, 60))]
        at = 0
        for i, k, p in runs.factors(s):
            assert i == at
            at += k
            if p >= 0:
                assert p < i and s[p : p + k] == s[i : i + k]
            if i + k < len(s):  # no longer stretch occurs before
                assert not any(s[j : j + k + 1] == s[i : i + k + 1] for j in range(i)) or (p < 0 and s[i] not in s[:i])
        assert at == len(s)


@pytest.mark.parametrize("least", [(24, 3), (6, 2)])
def test_runs_equal_all_stretches(least):
    r = random.Random(1)
    for k in range(1200):
        s: list[int] = []
        letters = r.choice([1, 2, 3, 5, 50])
        for _ in range(r.randint(1, 5)):
            s += [r.randrange(letters) for _ in range(r.randint(1, 12))] * r.randint(1, 9) + [r.randrange(letters) for _ in range(r.randint(0, 6))]
        s = s[:60] * r.randint(1, 4) if k % 4 == 0 else s
        assert runs.find_runs(s, *least) == all_runs(s, *least)


def test_stretches_hold_all_runs():
    from strandloom.llm.words import kgrams

    r = random.Random(4)
    texts = []
    for _ in range(300):
        t = [r.randrange(1000) for _ in range(r.randint(0, 60))]
        q = r.randint(1, 12)
        t += t[:q] * 3 + (t[:q] * 30)[: r.randint(0, 60)] + [r.randrange(1000) for _ in range(20)] + t[:30]
        texts.append(t)
    flat = np.asarray([x for t in texts for x in t], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = {}
    for i, s, e in runs.repeating(*kgrams(flat, at, 8, short=False), 8):
        found.setdefault(i, []).extend((a + s, n, q) for a, n, q in runs.find_runs(texts[i][s:e]))
    assert found and {i: v for i, v in found.items() if v} == {i: v for i, t in enumerate(texts) if (v := all_runs(t, 24, 3))}


def plain_runs(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = all_runs(w, 24, 3)
    drop = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def some(rows) -> list:
    return sorted(rows, key=repr)


def test_periodic_runs(spark, docs, empty):
    small = docs.where("length(text) < 9000 or text is null")
    got = runs.periodic_runs(small, tails=True).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert some(map(tuple, got.collect())) == some(plain_runs(r.doc_id, r.text) for r in small.collect())
    assert runs.periodic_runs(docs).count() == docs.count()
    assert runs.periodic_runs(empty).count() == 0
    x = runs.periodic_runs(docs).where("n_words = 30000").first()
    assert (x.n_runs, x.start, x.length, x.period, x.n_dropped) == (1, 0, 30000, 1, 29999)
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_words=8)


def test_periodic_runs_of_the_documents(spark, sf_dir):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000")
    got = runs.periodic_runs(rows, tails=True).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [plain_runs(r.doc_id, r.text) for r in rows.collect()]
    assert some(map(tuple, got.collect())) == some(want) and any(w[1] for w in want)


# --- 12


def plain_phrases(rows, least: int, top: int, share: int) -> list[tuple]:
    count: dict[str, Counter] = {}
    for text, lang in rows:
        c = count.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(b) > len(p) and any(b[i : i + len(p)] == p for i in range(len(b) - len(p) + 1)) and 100 * f >= share * a for b, f in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n, -s))
    return out


@pytest.mark.parametrize("cells", [phrases.MAX_CELLS, 1 << 16])
@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(docs, cells, top):
    got = phrases.collocations(docs, top=top, max_cells=cells)
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], 10, top, 50)
    assert some(map(tuple, got.collect())) == some(want) and len(want) > 10


def test_a_full_sketch_loses_nothing(spark, docs, monkeypatch):
    """All phrases in few cells: the second pass alone decides."""
    monkeypatch.setattr(phrases, "cells_of", lambda h, width, row: (h % np.uint64(50)).astype(np.int64) + row * width)
    want = plain_phrases([(r.text, r.lang) for r in docs.collect()], 10, 2000, 50)
    assert some(map(tuple, phrases.collocations(docs).collect())) == some(want)


def test_collocations_of_the_documents(spark, empty):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert some(map(tuple, phrases.collocations(rows).collect())) == some(plain_phrases([(r.text, r.lang) for r in rows.collect()], 10, 2000, 50))
    assert phrases.collocations(empty).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_000
    counts = spark.createDataFrame([("en", 1, "x", a + 7), ("en", 1, "y", 2 * a + 1), ("en", 2, "x y", a)], "lang string, k int, phrase string, f long")
    assert [r.score for r in phrases.scored(counts).collect()] == [1_000_000 * a * a // ((a + 7) * (2 * a + 1))]


# --- 13


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = bytepairs.read_ranks(queries.tokenizer_path(queries.BYTE_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_pieces_equal_the_library(library):
    enc, ranks = library
    r = random.Random(5)
    machine, tokens = bytepairs.Transducer(ranks, max_states=3000), list(ranks)
    for k in range(4000):
        b = b"".join(r.choice(tokens) for _ in range(r.randint(1, 6)))
        if k % 3 == 0:
            b = bytes(r.choice(b"aeiou tnrs") for _ in range(r.randint(1, 40)))
        b *= r.randint(1, 4) if k % 5 == 0 else 1
        assert machine.encode(b) == enc._core_bpe.encode_single_piece(b)


def test_a_vocabulary_whose_parts_rank_behind_their_whole():
    """Ranks that no training gives: against the merges themselves."""
    r = random.Random(6)
    for _ in range(40):
        words = {bytes(r.choices(b"abc", k=r.randint(2, 5))) for _ in range(12)}
        ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate(sorted(words, key=lambda _: r.random()))}
        machine = bytepairs.Transducer(ranks)
        if any(machine.merged(w) != [w] for w in words):
            continue  # some token can't be merged: the prefix property doesn't hold
        for _ in range(100):
            b = bytes(r.choices(b"abc", k=r.randint(1, 12)))
            assert machine.encode(b) == [ranks[t] for t in machine.merged(b)] or b in ranks


def test_tokens_leave_after_a_bounded_lookahead(library):
    _, ranks = library
    machine, read = bytepairs.Transducer(ranks), 0

    def source():
        nonlocal read
        for b in b"ab1-" * 5000:
            read += 1
            yield b

    sent, tokens = 0, {i: t for t, i in ranks.items()}
    for i in machine.stream(source()):
        sent += len(tokens[i])
        assert read - sent <= machine.ahead + 40


def test_decoder_equals_pythons(library):
    enc, ranks = library
    c = bytepairs.codec(queries.tokenizer_path(queries.BYTE_RANKS), enc._pat_str)
    r = random.Random(7)
    for k in range(1500):
        ids = [r.randrange(len(c.tokens)) for _ in range(r.randint(0, 8))]
        if k % 2:
            ids = enc.encode_ordinary("".join(chr(x) for x in r.choices(range(0x11000), k=5) if not 0xD800 <= x < 0xE000))
        d = bytepairs.StreamDecoder(c.tokens)
        raw = c.decode_bytes(ids)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == raw.decode("utf-8", "replace")
        chars, valid = c.steps.run(np.asarray(ids, np.int64))
        try:
            assert (len(raw.decode()), True) == (chars, valid)
        except UnicodeDecodeError:
            assert not valid


def test_round_trip(spark, docs, empty, library):
    enc, _ = library
    path = queries.tokenizer_path(queries.BYTE_RANKS)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = bytepairs.round_trip(docs, path, enc._pat_str).collect()
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()), len(r.text or ""), True))
    assert some(map(tuple, got)) == some(want)
    assert bytepairs.round_trip(empty, path, enc._pat_str).count() == 0
    back = bytepairs.decoded(bytepairs.encoded(docs, path, enc._pat_str), path)
    assert some(map(tuple, back.collect())) == some((r.doc_id, r.text or "") for r in docs.collect())


def test_round_trip_of_the_documents(spark, library):
    enc, _ = library
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_byte_pairs(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
