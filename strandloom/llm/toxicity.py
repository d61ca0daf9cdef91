"""Operator 6, toxicity: boosted trees over dense text features, calibrated isotonically.

A text becomes a short row of rates (lexicon densities, second-person proximity, capitals,
punctuation, obfuscation). Nothing but the text goes into them.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import scratch
from strandloom.llm.words import flat_words, slices

#: Labelled rows that the model is fitted on, at most: those of least hash. Only training is bounded.
MAX_TRAIN = 12_000
#: Words of the learnt lexicon, at most.
MAX_LEXICON = 400
THRESHOLD = 0.7
#: Folds of the labelled rows for the calibration.
FOLDS = 4

# Common insults, and second-person words of the four languages.
INSULTS = ("idiot", "moron", "stupid", "loser", "trash", "garbage", "worthless", "pathetic", "disgusting", "scum", "dumb", "clown", "fool", "hate", "ugly", "liar", "coward", "imbecile", "dummkopf", "idiota", "imbécile", "estúpido")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te", "vous", "votre", "tú", "ti", "usted", "vosotros")

FEATURES = (
    "seed_count", "seed_density", "learnt_count", "learnt_density", "learnt_sum", "learnt_max", "learnt_distinct", "near_person", "person_density",
    "upper_rate", "upper_words", "punct_rate", "exclaim_rate", "symbol_rate", "digit_in_word", "repeat_letters", "log_words", "mean_word",
    "seed_distinct", "sign_in_word",
)
#: Digits and signs for letters; 1, ! and @ stand for either of two.
_LEET = tuple(str.maketrans("013457@$!", "o" + one + "east" + at + "s" + bang) for one in "li" for bang in "il" for at in "ao")
#: Signs inside of words that can stand for a letter: * for any, others as above.
_SIGNS = "@$!*"


def _plain(word: str, known: Collection[str] = ()) -> str:
    """A word without obfuscation: digits and signs for letters, and stretched letters, undone; the
    first reading that is ``known``, else the first."""
    first = None
    for table in _LEET:
        w = word.translate(table)
        w = "".join(c for i, c in enumerate(w) if i < 2 or not (c == w[i - 1] == w[i - 2]))
        if w in known:
            return w
        first = w if first is None else first
        if not any(c in "1!@" for c in word):
            break
    return first


def _unmasked(word: str, known: Collection[str], by_length: dict[int, list[str]]) -> str | None:
    """The known word that ``word``, with signs, hides; None if it hides none. Signs around a word are
    punctuation unless they make it a known one; of masked letters two thirds must be left."""
    for w in dict.fromkeys((word, word.rstrip(_SIGNS), word.strip(_SIGNS))):
        if not any(c in _SIGNS for c in w):
            return None
        if "*" not in w:
            found = _plain(w, known)
            if found in known:
                return found
        elif 3 * w.count("*") <= len(w):
            for table in _LEET:
                v = w.translate(table)
                for k in by_length.get(len(v), ()):
                    if all(a in ("*", b) for a, b in zip(v, k, strict=True)):
                        return k
    return None


def masked_words(texts: pa.Array, known: Collection[str]) -> tuple[list[str], list[str | None], np.ndarray, np.ndarray]:
    """(words, the known word that each hides behind signs or None, codes, offsets) of a batch.

    Words are those of ``flat_words``, but a stretch with signs in it that hides a known word is one.
    """
    wide, codes, offsets = flat_words(texts, signs=_SIGNS)
    words = wide.to_pylist()
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(wide, f"[{_SIGNS}]"), bool)) if len(wide) else np.zeros(0, np.int64)
    hidden: list[str | None] = [None] * len(words)
    if not len(odd):
        return words, hidden, codes, offsets
    by_length: dict[int, list[str]] = {}
    for k in sorted(known):
        by_length.setdefault(len(k), []).append(k)
    # every word becomes the codes of its parts: itself, or what lies between its signs
    at = {w: i for i, w in enumerate(words)}
    parts, size = {}, np.ones(len(words), np.int64)
    for i in odd:
        found = _unmasked(words[i], known, by_length)
        if found is not None:
            hidden[i] = found
            continue
        own = []
        for x in words[i].translate(_APART).split():
            if x not in at:
                at[x] = len(words)
                words.append(x)
                hidden.append(None)
            own.append(at[x])
        parts[i], size[i] = own, len(own)
    first = np.concatenate([[0], np.cumsum(size)])
    table = np.empty(first[-1], np.int64)
    single = np.ones(len(size), bool)
    single[list(parts)] = False
    table[first[:-1][single]] = np.flatnonzero(single)
    for i, own in parts.items():
        table[first[i] : first[i + 1]] = own
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    return words, hidden, table[np.repeat(first[codes], n) + inner], ends[offsets]


_APART = str.maketrans(dict.fromkeys(_SIGNS, " "))


def features(texts: pa.Array, learnt: dict[str, float], near: int = 5) -> np.ndarray:
    """One row of FEATURES per text; a null or empty text gives zeros. Vectorised over the batch."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    col = {f: i for i, f in enumerate(FEATURES)}
    seeds, persons = set(INSULTS), set(SECOND_PERSON)
    known = seeds | learnt.keys()
    vocabulary, hidden, codes, offsets = masked_words(texts, known)
    plain = [h or (w if w.isalpha() and w in learnt else _plain(w, known)) for w, h in zip(vocabulary, hidden, strict=True)]
    signed = np.fromiter((h is not None for h in hidden), bool, len(plain))
    is_seed = np.fromiter((p in seeds for p in plain), bool, len(plain))
    weight = np.fromiter((learnt.get(w, learnt.get(p, 0.0)) for w, p in zip(vocabulary, plain, strict=True)), float, len(plain))
    is_person = np.fromiter((w in persons for w in vocabulary), bool, len(plain))
    odd = np.fromiter((any(c.isdigit() for c in w) and not w.isdigit() for w in vocabulary), bool, len(plain))
    stretched = np.fromiter((p != w and not o and h is None for w, p, o, h in zip(vocabulary, plain, odd, hidden, strict=True)), bool, len(plain))
    length = np.fromiter(map(len, vocabulary), float, len(plain))
    doc = np.repeat(np.arange(n), np.diff(offsets))
    count = np.maximum(np.diff(offsets), 1)
    total = lambda x: np.bincount(doc, weights=x, minlength=n)
    seed, w, person = is_seed[codes], weight[codes], is_person[codes]
    out[:, col["seed_count"]] = total(seed)
    out[:, col["seed_density"]] = total(seed) / count
    out[:, col["learnt_count"]] = total(w > 0)
    out[:, col["learnt_density"]] = total(w > 0) / count
    out[:, col["learnt_sum"]] = total(w) / count
    hits = np.flatnonzero(w > 0)
    np.maximum.at(out[:, col["learnt_max"]], doc[hits], w[hits])
    pairs = np.unique(doc[hits] * (len(plain) + 1) + codes[hits])
    out[:, col["learnt_distinct"]] = np.bincount(pairs // (len(plain) + 1), minlength=n)
    spoken = {p: i for i, p in enumerate(seeds)}
    kind = np.fromiter((spoken.get(p, -1) for p in plain), np.int64, len(plain))[codes]
    pairs = np.unique(doc[seed] * len(seeds) + kind[seed])
    out[:, col["seed_distinct"]] = np.bincount(pairs // len(seeds), minlength=n)
    out[:, col["sign_in_word"]] = total(signed[codes]) / count
    ran = np.concatenate([[0], np.cumsum(person)])  # second-person words around each hit, inside its text
    lexical = np.flatnonzero((w > 0) | seed)
    lo, hi = np.maximum(lexical - near, offsets[doc[lexical]]), np.minimum(lexical + near + 1, offsets[doc[lexical] + 1])
    out[:, col["near_person"]] = np.bincount(doc[lexical], weights=ran[hi] - ran[lo] > 0, minlength=n)
    out[:, col["person_density"]] = total(person) / count
    out[:, col["digit_in_word"]] = total(odd[codes]) / count
    out[:, col["repeat_letters"]] = total(stretched[codes]) / count
    out[:, col["log_words"]] = np.log1p(np.diff(offsets))
    out[:, col["mean_word"]] = total(length[codes]) / count
    # characters by class, on the bytes of all texts at once
    at = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts), np.int64))])
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    size = np.maximum(np.diff(at), 1)
    kinds = _BYTE_KINDS[raw]
    upper_run = np.zeros(len(raw), bool)
    if len(raw) > 1:
        up = kinds == 1
        upper_run[1:] = up[1:] & up[:-1]
    for name, flag in (("upper_rate", kinds == 1), ("upper_words", upper_run), ("punct_rate", kinds >= 2), ("exclaim_rate", kinds == 3), ("symbol_rate", kinds == 4)):
        ran = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        out[:, col[name]] = (ran[at[1:]] - ran[at[:-1]]) / size
    return out


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[ord("A") : ord("Z") + 1] = 1
    for kind, chars in ((2, ".,;:'\"()-"), (3, "!?"), (4, "#*$%&@^~_|<>")):
        for c in chars:
            kinds[ord(c)] = kind
    return kinds


_BYTE_KINDS = _byte_kinds()


@dataclass
class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins."""

    edges: list[np.ndarray]
    trees: list[np.ndarray]  #: per tree, rows of feature, bin, left, right, value
    start: float
    calibration: tuple[np.ndarray, np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = tree[at, 0] >= 0
                if not inner.any():
                    break
                f, cut = tree[at, 0].astype(np.int64), tree[at, 1]
                at = np.where(inner, np.where(b[rows, np.maximum(f, 0)] <= cut, tree[at, 2], tree[at, 3]), at).astype(np.int64)
            out += tree[at, 4]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability, between the steps of the isotonic fit linear."""
        return np.clip(np.interp(self.margin(x), *self.calibration), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (places, fitted means), one knot per pool; rows count ``weight`` times."""
    order = np.argsort(x, kind="stable")
    weight = np.ones(len(x)) if weight is None else weight
    pools: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([w * b, w, w * a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.asarray([p[2] / p[1] for p in pools]), np.asarray([p[0] / p[1] for p in pools])


#: Margin and probability where nothing is calibrated.
_LOGISTIC = (np.linspace(-8, 8, 65), 1 / (1 + np.exp(-np.linspace(-8, 8, 65))))


def grow_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8, ridge: float = 1.0) -> Boosted:
    """Trees only; the calibration is that of the bare logistic margin. A row counts ``weight`` times."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Boosted(edges, [], 0.0, _LOGISTIC)
    b, t = model.bins(x), y
    p = np.clip(np.average(t, weights=weight), 1e-3, 1 - 1e-3)
    model.start = float(np.log(p / (1 - p)))
    margin = np.full(len(t), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (t - p), weight * p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, left: int) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0, 0, 0, rate * gs / (hs + ridge)])
            if not left or len(rows) < 2 * least:
                margin[rows] += nodes[me][4]
                return me
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = b[rows, j]
                gc = np.cumsum(np.bincount(k, g[rows], len(e) + 1))[:-1]
                hc = np.cumsum(np.bincount(k, h[rows], len(e) + 1))[:-1]
                nc = np.cumsum(np.bincount(k, minlength=len(e) + 1))[:-1]
                gain = gc**2 / (hc + ridge) + (gs - gc) ** 2 / (hs - hc + ridge) - gs**2 / (hs + ridge)
                gain[(nc < least) | (len(rows) - nc < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, i)
            if best[1] < 0:
                margin[rows] += nodes[me][4]
                return me
            go = b[rows, best[1]] <= best[2]
            lo, hi = grow(rows[go], left - 1), grow(rows[~go], left - 1)
            nodes[me][:4] = [best[1], best[2], lo, hi]
            return me

        grow(np.arange(len(t)), depth)
        model.trees.append(np.asarray(nodes, float))
    return model


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, part: np.ndarray | None = None, folds: int = FOLDS) -> Boosted:
    """Trees on all rows; the isotonic curve on the margins that each fold gets from the others' trees.

    ``x``: features of all rows with the lexicon of all rows, or, by a first axis more, these and
    then those with the lexicon that each fold's outside gives, so that no margin of a fold has
    seen its labels. ``part``: the fold of each row. ``weight``: the rows that a sampled row
    stands for, so that the prior is that of all rows.
    """
    x = x if x.ndim == 3 else np.stack([x] * (folds + 1))
    weight = np.ones(len(y)) if weight is None else weight
    part = np.arange(len(y)) % folds if part is None else part
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Boosted([np.zeros(0)] * x.shape[2], [], 0.0, (np.asarray([0.0]), np.asarray([p])))
    # quantities of evidence stay those of the sample: its weights have mean 1
    weight = weight / weight.mean()
    model = grow_trees(x[0], y, weight)
    margins, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(folds):
        own = part == k
        if own.any() and not own.all() and 0 < y[~own].sum() < (~own).sum():
            margins[own] = grow_trees(x[k + 1][~own], y[~own], weight[~own]).margin(x[k + 1][own])
            known |= own
    if known.any():
        model.calibration = isotonic(margins[known], y[known], weight[known])
    return model


def learn_lexicons(sample: DataFrame, folds: int = FOLDS, most: int = MAX_LEXICON, least_docs: int = 4, ratio: float = 4.0) -> list[dict[str, float]]:
    """Words much more common in label-1 texts than elsewhere, with their log odds: from all rows
    of ``sample`` (text, toxic, part), then from those outside of each fold.

    Document frequencies are summed up by Spark; only the ``most`` strongest words of each
    lexicon come to the driver.
    """
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0), 2 << 20):
                words, codes, offsets = flat_words(b.column(0)[lo:hi])
                kind = np.asarray(b.column(1)[lo:hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(offsets))
                pairs = np.unique(doc * (len(words) + 1) + codes)
                d, c = pairs // (len(words) + 1), pairs % (len(words) + 1)
                for k in np.unique(kind):
                    n = np.bincount(c[kind[d] == k], minlength=len(words))
                    own = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(own)).cast(pa.string()), pa.array(np.full(len(own), k, np.int32)), pa.array(n[own].astype(np.int64))], schema.names)

    # kind: 2 x fold + label
    marked = sample.select("text", (2 * F.col("part") + F.col("toxic")).cast("int").alias("kind"))
    totals = {r["kind"]: r["n"] for r in marked.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}")
    counts = scratch(marked.mapInArrow(run, schema).groupBy("word").agg(*[of(k) for k in range(2 * folds)]), "words")
    out = []
    for left_out in (None, *range(folds)):
        kinds = [[2 * k + y for k in range(folds) if k != left_out] for y in (0, 1)]
        good, bad = (sum(totals.get(k, 0) for k in x) for x in kinds)
        if not bad or not good:
            out.append({})
            continue
        n_good, n_bad = (sum((F.col(f"k{k}") for k in x), F.lit(0)) for x in kinds)
        rate = (n_bad + 0.5) / (bad + 1) / ((n_good + 0.5) / (good + 1))
        # scaled by the evidence: a word of four texts says less than one of four hundred
        strength = F.log(rate) * F.sqrt(n_bad)
        rows = counts.where((n_bad >= least_docs) & (rate >= ratio)).select("word", F.log(rate).alias("odds"), strength.alias("s")).orderBy(F.desc("s"), "word").limit(most).collect()
        out.append({r["word"]: float(r["odds"]) for r in rows})
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.trees.score(features(texts, self.lexicon))


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt: crc32 of the id as text, remainder 1 by 3."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("long").cast("string"), "UTF-8")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, folds: int = FOLDS) -> ToxicityModel:
    """Learn from at most ``max_train`` labelled rows that aren't held out.

    The sample's ids (bounded) are broadcast, so texts aren't shuffled to find its rows; their
    features, not their texts, come to the driver: a row an id, the least text of rows that
    repeat one. A sampled row weighs as many rows of its label as it stands for, so scores keep
    to the prior of all usable labels, whatever their number. Contradicting labels of a row count
    as 1; null labels don't count; without labels of both kinds every score is the prior.
    """
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = scratch(usable, "usable")
    labelled = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the rarer label 1 gets half of the room, so that the bound doesn't leave it with a few rows
    half = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(max_train // 2) for y in (0, 1)]
    chosen = scratch(half[0].unionByName(half[1]), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a row of ``chosen`` is two numbers and there are at most max_train
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = scratch(found.withColumn("part", F.pmod(F.xxhash64(F.lit(folds), "doc_id"), F.lit(folds)).cast("int")), "sample")
    lexicons = learn_lexicons(sample, folds)
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("toxic", T.IntegerType()), ("part", T.IntegerType()), ("x", T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2), 2 << 20):
                x = np.concatenate([features(b.column(2)[lo:hi], lexicon) for lexicon in lexicons], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], b.column(3)[lo:hi], pa.array(x.tolist(), pa.list_(pa.float64()))], schema.names)

    rows = sorted(sample.mapInArrow(run, schema).collect(), key=lambda r: r["doc_id"])  # max_train at most
    x = np.asarray([r["x"] for r in rows]).reshape(len(rows), folds + 1, len(FEATURES)).transpose(1, 0, 2)
    y, part = (np.asarray([r[k] for r in rows], t) for k, t in (("toxic", float), ("part", int)))
    weight = np.ones(len(y))
    for label in (0, 1):  # of ids chosen: rows of ids that aren't in the documents count as their like
        weight[y == label] = max(labelled.get(label, 0) / (max_train // 2), 1.0)
    return ToxicityModel(lexicons[0], fit(x, y, weight, part, folds))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, null as empty. Narrow.

    Repeated rows each give a row; a null id isn't held out; an empty table gives none.
    The model is broadcast; its size is bounded by its parameters (trees, lexicon).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), 2 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(shared.value.score(b.column(1)[lo:hi]))], schema.names)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, all columns kept. Narrow: rows are filtered in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            for lo, hi in slices(b.column(i), 2 << 20):
                part = b.slice(lo, hi - lo)
                yield part.filter(pa.array(shared.value.score(part.column(i)) < threshold))

    return docs.mapInArrow(run, docs.schema)
