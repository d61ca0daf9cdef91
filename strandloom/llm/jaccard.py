"""Operator 4, n-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Documents with equal shingle sets are one node; nodes that share a MinHash band are candidates.
Classes are found in two parts, neither of which emits the pairs of a group:

* Stars: in each band a leader meets every other node, so a band of n nodes costs n pairs. Their
  MinHash values are compared a few at a time, pairs whose posterior probability of reaching the
  threshold falls below the tolerance are dropped, the rest are verified on the sets. The next
  rounds take other leaders, and only bands that still hold several classes.
* The rest: nodes of bands that still hold several classes are compared across classes inside
  Python, in blocks of bounded size, and only pairs that join two classes leave it. The largest
  class of a cluster isn't compared with itself, so a group of near copies costs a row a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import connected_components, scratch
from strandloom.llm.words import flat_words, hash_words, kgrams, mix, slices

#: Words of a shingle, and the least similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Bands and MinHash values of a band: two nodes at the threshold share none with probability 3e-6.
BANDS, ROWS = 24, 4
#: A pair is dropped when the posterior probability of a link is below this.
TOLERANCE = 1e-6
#: MinHash values compared at a time.
STEP = 16
#: Nodes and bytes of shingle sets of a block, on average; blocks bound the memory of a task, whatever a cluster's size.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Nodes of a block in which links are counted, at most: so many that a large class is spread over tasks.
COUNTED = 2048
#: Rounds of stars; every round has other leaders.
ROUNDS = 2


def minhashes(shingles: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(documents x n) 32-bit MinHash values; rows of documents without shingles are meaningless."""
    docs = len(offsets) - 1
    out = np.zeros((docs, n), np.uint32)
    own = np.flatnonzero(np.diff(offsets) > 0)
    if not len(own):
        return out
    starts = offsets[:-1][own]
    base = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = shingles.astype(np.uint32)
    rng = np.random.default_rng(20240607)
    for j in range(n):
        a, b = (np.uint32(x) for x in rng.integers(0, 2**32, 2, dtype=np.uint64))
        h = (base ^ a) * np.uint32(0x9E3779B1)  # a keyed mixer of 64 bits to 32
        h ^= h >> np.uint32(15)
        h += low ^ b
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(16)
        out[own, j] = np.minimum.reduceat(h, starts)
    return out


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, offsets). Fewer words than a shingle are one."""
    vocabulary, codes, offsets = flat_words(texts)
    grams, at = kgrams(hash_words(vocabulary)[codes], offsets, words, short=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[first], doc[first]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)


def set_digests(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes that identify a set: two sums of mixed members. Empty sets give b''."""
    out = []
    n = np.diff(offsets)
    sums = []
    for salt in (0x51ED270B0A1F39C1, 0xD1B54A32D192ED03):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append(total[offsets[1:]] - total[offsets[:-1]])
    for i, k in enumerate(n):
        out.append(b"" if not k else sums[0][i].tobytes() + sums[1][i].tobytes())
    return out


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, step: int, n: int) -> tuple[int, ...]:
    """For step, 2 step, ... compared values: fewer matches than this prune a pair.

    With a uniform prior the posterior after m of k matches is Beta(m + 1, k - m + 1), and its
    mass from the threshold on is P(Bin(k + 1, threshold) <= m), summed exactly.
    """
    out = []
    for k in range(step, n + 1, step):
        mass = 0.0
        for m in range(k + 1):
            mass += exp(lgamma(k + 2) - lgamma(m + 1) - lgamma(k + 2 - m) + m * log(threshold) + (k + 1 - m) * log(1 - threshold))
            if mass >= tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving(sig_a: np.ndarray, sig_b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Row numbers of the pairs of signatures that pruning leaves."""
    on, matches = np.arange(len(sig_a)), np.zeros(len(sig_a), np.int64)
    for part, need in enumerate(least_matches(threshold, tolerance, STEP, sig_a.shape[1])):
        cut = slice(part * STEP, (part + 1) * STEP)
        matches = matches + (sig_a[on, cut] == sig_b[on, cut]).sum(axis=1)
        on, matches = on[matches >= need], matches[matches >= need]
    return on


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``threshold``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < threshold * len(large) - 1e-9:
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


_NODE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("size", T.LongType())])
_SET = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("grams", T.BinaryType())])
_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_COUNT = T.StructType([T.StructField("l_rep", T.LongType()), T.StructField("links", T.LongType())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, words: int = WORDS, n: int = BANDS * ROWS) -> DataFrame:
    """doc_id, node (digest of the shingle set; null without words), signature, size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                grams, at = shingle_sets(b.column(1)[lo:hi], words)
                sigs, nodes = minhashes(grams, at, n), [x or None for x in set_digests(grams, at)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(nodes, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array(np.diff(at))], _NODE.names)

    return _texts(docs).mapInArrow(run, _NODE)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                grams, at = shingle_sets(b.column(1)[lo:hi], words)
                rows = [grams[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(rows, pa.binary())], _SET.names)

    return docs.mapInArrow(run, _SET)


def _as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _pairs(schema_names: list[str], rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if len(rows) else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema_names)


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Of ``pairs`` (a, b) those that are links: pruned on signatures first, then compared on the sets."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = pa.array(surviving(_as_signatures(x.column(2)), _as_signatures(x.column(3)), threshold, tolerance))
                yield pa.RecordBatch.from_arrays([x.column(0).take(keep), x.column(1).take(keep)], _LINK.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets_a, sets_b = ([np.frombuffer(g, np.uint64) for g in x.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([similar(a, b, threshold) for a, b in zip(sets_a, sets_b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], _LINK.names)

    def beside(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
        left = df.join(table.select(F.col(key).alias("k_a"), F.col(value).alias("v_a")), F.col("a") == F.col("k_a")).drop("k_a")
        return left.join(table.select(F.col(key).alias("k_b"), F.col(value).alias("v_b")), F.col("b") == F.col("k_b")).select("a", "b", "v_a", "v_b")

    likely = beside(pairs, nodes, "rep", "signature").mapInArrow(prune, _LINK)
    return beside(likely, sets, "doc_id", "grams").mapInArrow(compare, _LINK)


def _block_links(rows: list[dict], threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """Of one block pair: links that join classes, each pair of classes once (a forest of them)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] = root.setdefault(up, up)
            x = root[x]
        return x

    left = [r for r in rows if r["side"] != 1]
    right = [r for r in rows if r["side"] != 0]
    if not left or not right:
        return []
    sig, sets = (lambda x: np.stack([np.frombuffer(r["signature"], np.uint32) for r in x])), (lambda x: [np.frombuffer(r["grams"], np.uint64) for r in x])
    sig_a, sig_b, sets_a, sets_b = sig(left), sig(right), sets(left), sets(right)
    classes = np.asarray([r["class"] for r in right], np.int64)
    sizes = np.fromiter(map(len, sets_b), np.int64, len(sets_b))
    same, out = rows[0]["side"] == 2, []
    for i, r in enumerate(left):
        n = len(sets_a[i])
        js = np.flatnonzero((classes != r["class"]) & (np.minimum(sizes, n) >= threshold * np.maximum(sizes, n) - 1e-9))
        js = js[js > i] if same else js
        for j in js[surviving(np.broadcast_to(sig_a[i], (len(js), sig_a.shape[1])), sig_b[js], threshold, tolerance)]:
            x, y = find(r["class"]), find(int(classes[j]))
            if x != y and similar(sets_a[i], sets_b[j], threshold):
                root[max(x, y)] = min(x, y)
                out.append((r["rep"], right[j]["rep"]))
    return out


def _linked(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b of every block pair: ``blocks`` is sorted by (cluster, p, q) within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for b in batches:
            for row in b.to_pylist():
                now = (row["cluster"], row["p"], row["q"])
                if now != key:
                    out += _block_links(group, threshold, tolerance) if len(group) > 1 else []
                    key, group = now, []
                    if len(out) > 20_000:
                        yield _pairs(_LINK.names, out)
                        out = []
                group.append(row)
        out += _block_links(group, threshold, tolerance) if len(group) > 1 else []
        yield _pairs(_LINK.names, out)

    return blocks.mapInArrow(run, _LINK)


def _block_counts(rows: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Of one block pair: (rep, documents with which it is linked there), on the sets."""
    left = [r for r in rows if r["side"] != 1]
    right = [r for r in rows if r["side"] != 0]
    if not left or not right:
        return []
    sets_a, sets_b = ([np.frombuffer(r["grams"], np.uint64) for r in x] for x in (left, right))
    sizes = np.fromiter(map(len, sets_b), np.int64, len(sets_b))
    at = np.concatenate([[0], np.cumsum(sizes)])
    known, codes = np.unique(np.concatenate(sets_b), return_inverse=True)
    codes = codes.astype(np.int32)
    copies_a, copies_b = (np.fromiter((r["copies"] for r in x), np.int64, len(x)) for x in (left, right))
    got_a, got_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    same, mark = rows[0]["side"] == 2, np.zeros(len(known), bool)
    for i, a in enumerate(sets_a):
        j = i + 1 if same else 0  # in a block of its own each pair once
        if j == len(right):
            break
        own = np.minimum(np.searchsorted(known, a), len(known) - 1)
        own = own[known[own] == a]
        mark[own] = True
        both = np.add.reduceat(mark[codes[at[j] :]], at[j:-1] - at[j], dtype=np.int64)
        mark[own] = False
        on = j + np.flatnonzero(both >= threshold * (len(a) + sizes[j:] - both) - 1e-9)
        got_a[i] += copies_b[on].sum()
        got_b[on] += copies_a[i]
    counts = [(left, got_a), (right, got_b)]
    return [(r["rep"], int(n)) for side, got in counts for r, n in zip(side, got, strict=True) if n]


def link_counts(labels: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, block: int, block_bytes: int) -> DataFrame:
    """l_rep, links: the documents of other nodes that each node is linked with; ``labels``: rep, class.

    Links lie inside classes. A class fills blocks of bounded size, each of which meets all others, so a
    node is in as many rows as its class fills blocks.
    """
    who = labels.join(nodes.select(F.col("rep").alias("n_rep"), "copies", "size"), F.col("rep") == F.col("n_rep")).drop("n_rep")
    full = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("size") * F.lit(8) / F.lit(block_bytes))).cast("int")
    parts = who.groupBy(F.col("class").alias("p_class")).agg(F.count(F.lit(1)).alias("n"), full.alias("parts")).where("n > 1").drop("n")
    at = who.join(parts, F.col("class") == F.col("p_class")).select("class", "rep", "copies", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    at = at.select("class", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), side.alias("side"), "rep", "copies")
    rows = at.join(sets, F.col("rep") == F.col("doc_id")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for b in batches:
            for row in b.to_pylist():
                now = (row["class"], row["p"], row["q"])
                if now != key:
                    out += _block_counts(group, threshold) if len(group) > 1 else []
                    key, group = now, []
                    if len(out) > 20_000:
                        yield _pairs(_COUNT.names, out)
                        out = []
                group.append(row)
        out += _block_counts(group, threshold) if len(group) > 1 else []
        yield _pairs(_COUNT.names, out)

    counted = rows.repartition("class", "p", "q").sortWithinPartitions("class", "p", "q").mapInArrow(run, _COUNT)
    return counted.groupBy("l_rep").agg(F.sum("links").alias("links"))


#: Ids that are broadcast at most (8 bytes each) where a join picks documents by id.
MAX_BROADCAST_IDS = 500_000


def pick(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with ``ids`` (doc_id). Broadcast only if counted to be small."""
    if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].cast("long") == ids["id"], how)


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (rep, class) after the links (a, b: reps) have joined classes."""
    ends = links.join(labels.select(F.col("rep").alias("r_a"), F.col("class").alias("a_class")), F.col("a") == F.col("r_a")).join(labels.select(F.col("rep").alias("r_b"), F.col("class").alias("b_class")), F.col("b") == F.col("r_b"))
    joined = connected_components(ends.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
    new = labels.join(joined.select(F.col("node").alias("old"), "component"), F.col("class") == F.col("old"), "left")
    return new.select("rep", F.coalesce("component", "class").alias("class"))


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their classes of now, in bands that hold several."""
    now = members.drop("class").join(labels.withColumnRenamed("rep", "l_rep"), F.col("rep") == F.col("l_rep")).drop("l_rep")
    bands = now.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select(F.col("band").alias("o_band"))
    return now.join(bands, F.col("band") == F.col("o_band")).select("rep", "band", "class", "weight")


def band_members(bands: DataFrame) -> DataFrame:
    """rep, band, class (rep itself), weight of ``bands`` (rep, band), where two nodes or more share a band.

    weight: nodes in all bands of this one, so that the texts in the middle of a group weigh most.
    """
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("s_band"), "n")
    own = scratch(bands.join(shared, F.col("band") == F.col("s_band")).select("rep", "band", "n"), "bands")
    weights = own.groupBy(F.col("rep").alias("w_rep")).agg(F.sum("n").alias("weight"))
    return own.join(weights, F.col("rep") == F.col("w_rep")).select("rep", "band", F.col("rep").alias("class"), "weight")


def star_pairs(members: DataFrame, round_: int) -> DataFrame:
    """a, b: in each band the leader of this round with every node of another class, each pair once.

    The first round is led by the nodes of most weight, later ones by hash.
    """
    order = -F.col("weight") if not round_ else F.xxhash64(F.lit(round_), "rep")
    lead = members.groupBy("band").agg(F.min(F.struct(order.alias("o"), "rep", "class")).alias("lead"), F.min("class").alias("least"), F.max("class").alias("most"))
    lead = lead.where("least <> most").select(F.col("band").alias("l_band"), F.col("lead.rep").alias("l_rep"), F.col("lead.class").alias("l_class"))
    met = members.join(lead, F.col("band") == F.col("l_band")).where("class <> l_class")
    return met.select(F.least("rep", "l_rep").alias("a"), F.greatest("rep", "l_rep").alias("b")).distinct()


def dealt_blocks(members: DataFrame, nodes: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """cluster, p, q, side, class, rep: the block pairs in which nodes of different classes meet.

    ``members``: of bands that hold several classes; a cluster is what such bands connect. The
    largest class of a cluster fills blocks of its own, which meet the other blocks but not each
    other: a node of it is in as many pairs as the k others fill blocks. So a cluster of n nodes
    takes about n * k / block rows, n if the others fit one block; only where thousands of texts
    share bands without a link between them does the work grow faster than the group.
    """
    least = members.groupBy("band").agg(F.min("class").alias("least")).withColumnRenamed("band", "o_band")
    apart = members.join(least, F.col("band") == F.col("o_band")).where("class <> least")
    clusters = connected_components(apart.select(F.col("least").alias("a"), F.col("class").alias("b")))
    who = members.select("rep", "class").distinct().join(clusters.select("node", F.col("component").alias("cluster")), F.col("class") == F.col("node")).drop("node")
    who = scratch(who.join(nodes.select(F.col("rep").alias("n_rep"), "size"), F.col("rep") == F.col("n_rep")).drop("n_rep"), "open")
    per = who.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    of = per.groupBy("cluster").agg(F.max(F.struct("n", "class", "grams")).alias("top"), F.sum("n").alias("n"), F.sum("grams").alias("grams"))
    full = lambda n, grams: F.ceil(F.greatest(n / F.lit(block), grams * F.lit(8) / F.lit(block_bytes))).cast("int")
    of = of.select(F.col("cluster").alias("t_cluster"), F.col("top.class").alias("top"), full(F.col("top.n"), F.col("top.grams")).alias("tops"), full(F.col("n") - F.col("top.n"), F.col("grams") - F.col("top.grams")).alias("others"))
    at = who.join(of, F.col("cluster") == F.col("t_cluster"))
    is_top = F.col("class") == F.col("top")
    mine = F.when(is_top, F.col("others") + F.pmod(F.xxhash64("rep"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("others"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1)
    at = at.select("cluster", "rep", "class", mine.alias("mine"), F.explode(meets).alias("other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return at.select("cluster", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), side.alias("side"), "class", "rep")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id, rep_id, n_links: one row per row of ``docs``.

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity
    of at least ``threshold``; a class is a connected component of links, named by its least
    doc_id. rep_id is the least document with the same shingle set. n_links counts all documents
    that are linked to this one: copies, and those of its class that reach the threshold, compared
    on the sets. No link between classes is missed but by pruning or by sharing no band (with
    the defaults, at the threshold, with probabilities of 1e-6 and 3e-6).

    Texts are taken whole, whatever their length; those of fewer words are one shingle; null
    texts and texts without words have no links. Rows of one doc_id and one text are one node;
    texts that only rows without an id have are left alone. Other columns are ignored; an empty table gives none.
    """
    base = scratch(signatures(docs, words), "signatures")
    nodes = scratch(base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("size").alias("size")), "nodes")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    bands = nodes.where("rep is not null").select("rep", F.explode(keys).alias("band"))
    members = scratch(band_members(bands), "members")
    chosen = pick(_texts(docs), members.select(F.col("rep").alias("id")).distinct(), "left_semi").where("doc_id is not null")
    # rows that repeat an id with other texts: the representative's set is that of its node
    sets = scratch(_sets(chosen, words).join(nodes.select(F.col("rep").alias("n_rep"), "size"), F.col("doc_id") == F.col("n_rep")).where(F.octet_length("grams") == 8 * F.col("size")).groupBy("doc_id").agg(F.first("grams").alias("grams")), "sets")
    labels = scratch(members.select("rep", "class").distinct(), "labels")
    for r in range(rounds + 1):
        if r < rounds:
            found = verified(star_pairs(members, r), nodes, sets, threshold, tolerance)
        else:
            dealt = dealt_blocks(members, nodes, block, block_bytes)
            dealt = dealt.join(nodes.select(F.col("rep").alias("n_rep"), "signature"), F.col("rep") == F.col("n_rep")).join(sets, F.col("rep") == F.col("doc_id")).drop("n_rep", "doc_id")
            found = _linked(dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q"), threshold, tolerance)
        found = scratch(found, "links")
        labels = scratch(relabelled(labels, found), "labels")
        members = scratch(still_open(members, labels), "members") if r < rounds else members
    counted = scratch(link_counts(labels, nodes, sets, threshold, min(block, COUNTED), block_bytes), "counts")
    classes = labels.select(F.col("rep").alias("c_rep"), "class")
    of_node = nodes.select(F.col("node").alias("n_node"), "rep", "copies").join(counted, F.col("rep") == F.col("l_rep"), "left").join(classes, F.col("rep") == F.col("c_rep"), "left")
    of_node = of_node.select("n_node", "rep", F.coalesce("class", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.select("doc_id", "node").join(of_node, F.col("node") == F.col("n_node"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, the one of least doc_id; all columns kept.

    Rows that repeat a doc_id are one document, of which one row stays; null ids stay as they are.
    """
    found = scratch(near_duplicates(docs, **how), "classes")
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("id")).distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    kept = pick(docs, gone, "left_anti")
    if repeated:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept
