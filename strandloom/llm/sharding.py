"""Operator 10, sharding: balanced label propagation under exact row quotas.

DataFrame functions only. Texts are read once, for their size, checksum and digest; every
shuffle moves a few numbers a document. Nodes that share a hub (equal texts) are neighbours of
each other and of no one else, so nodes of a hub in one shard are interchangeable: labels are
propagated over counts by hub and shard, and rows are only dealt at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.common import salted_rank, scratch

#: Sub-groups that a hub, a shard or a target is dealt to, so that none is one task's.
SALTS = 256


def _numbers(values: list[int]) -> Column:
    """A literal array of a number a shard."""
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _sums(labels: DataFrame, shards: int) -> list[int]:
    """Rows in each shard: one row comes to the driver."""
    row = labels.agg(*[F.coalesce(F.sum(F.col("n")[s]), F.lit(0)).alias(f"s{s}") for s in range(shards)]).first()
    return [row[s] for s in range(shards)]


def _before(df: DataFrame, group: str, amount: str, key: str) -> DataFrame:
    """Add ``before``: the sum of ``amount`` of the rows ahead in ``group``, in order of a hash of
    ``key`` (unique in a group). Summed over salts first, so that a group isn't one task's."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    ahead = W.partitionBy(group).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sums = salted.groupBy(group, "salt").agg(F.sum(amount).alias("sum"))
    sums = sums.select(F.col(group).alias("b_group"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    inner = W.partitionBy(group, "salt").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    salted = salted.withColumn("inside", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    joined = salted.join(sums, (F.col(group) == F.col("b_group")) & (F.col("salt") == F.col("b_salt")))
    return joined.withColumn("before", F.col("base") + F.col("inside")).drop("salt", "base", "inside", "b_group", "b_salt")


def move_round(labels: DataFrame, room: list[int]) -> DataFrame:
    """One round of propagation over ``labels`` (hub, n: its rows in each shard); adds ``moved``.

    Each hub names the shard that holds most of its rows among those with room; its parts in
    other shards that aren't larger want to go there. Wishes are met until the shard's room is
    used up, the last one in part; small parts go first. Every row that moves gets more
    neighbours than it leaves, so each move cuts fewer links.
    """
    shards, hash_ = len(room), F.pmod(F.xxhash64("hub"), F.lit(len(room))).cast("int")
    spots = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.when(F.get(_numbers(room), s) > 0, F.get("n", s)).otherwise(-1).alias("n"), F.pmod(s + hash_, F.lit(shards)).alias("tie"), s.alias("s")))
    named = labels.select("hub", "n", F.array_max(spots).alias("top"))
    wants = F.aggregate(F.transform("n", lambda x, s: F.when((s != F.col("top.s")) & (x <= F.col("top.n")), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    wish = named.select("hub", "n", F.col("top.s").alias("to"), F.col("top.n").alias("most"), F.when(F.col("top.n") > 0, wants).otherwise(0).alias("wants"))
    granted = _before(wish, "to", "wants", "hub")
    granted = granted.withColumn("moved", F.greatest(F.least(F.get(_numbers(room), F.col("to")) - F.col("before"), F.col("wants")), F.lit(0)))
    # the smallest parts first: what is granted is taken from them in turn
    order = F.array_sort(F.transform("n", lambda x, s: F.struct(x.alias("x"), s.alias("s"))))
    start = F.struct(F.col("moved").alias("left"), F.col("n").alias("n"))

    def give(acc: Column, part: Column) -> Column:
        may = (part.s != F.col("to")) & (part.x <= F.col("most"))
        out = F.when(may, F.least(acc.left, part.x)).otherwise(F.lit(0).cast("long"))
        return F.struct((acc.left - out).alias("left"), F.transform(acc.n, lambda x, s: F.when(s == part.s, x - out).when(s == F.col("to"), x + out).otherwise(x)).alias("n"))

    return granted.select("hub", F.when(F.col("moved") > 0, F.aggregate(order, start, give).n).otherwise(F.col("n")).alias("n"), "moved")


def cut_links(labels: DataFrame) -> int:
    """Pairs of nodes of one hub that lie in different shards (hub, n: its rows in each shard)."""
    whole = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    same = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x * x)
    return labels.agg(F.coalesce(F.sum((whole * whole - same) / 2), F.lit(0)).cast("long").alias("cut")).first()["cut"]


def propagate_labels(labels: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """hub, n after rounds in which nothing moves any more, or ``rounds`` of them; rows in a shard
    are at most its quota but for what the start put over it."""
    labels = scratch(labels, "labels")
    for _ in range(rounds):
        room = [max(0, q - n) for q, n in zip(quota, _sums(labels, len(quota)), strict=True)]
        if not any(room):
            break
        moved = scratch(move_round(labels, room), "moved")
        labels = moved.select("hub", "n")
        if not moved.where("moved > 0").limit(1).count():
            break
    return labels


def propagate(nodes: DataFrame, shards: int, rounds: int = 30) -> DataFrame:
    """Put ``nodes`` (any columns, ``hub``: what links a node, null for none) into shards.

    Adds ``shard``: sizes differ by one row at most. Nodes of one hub are neighbours. Nodes start
    by hash; linked ones move towards their neighbours under the quotas until none gains (see
    ``move_round``); unlinked ones fill what is left. A round may move any node again. ``rounds``
    only bounds the loop: shards are even whenever it ends. Hubs are dealt by a salt, so a hub
    with any share of all nodes is in no task alone.
    """
    ids = [c for c in nodes.columns if c != "hub"]
    salted = nodes.withColumn("cell", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int"))
    cells = scratch(salted.where("hub is not null").groupBy("hub", "cell").agg(F.count(F.lit(1)).alias("rows")), "cells")
    total = nodes.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    counts = [F.sum(F.when(F.col("cell") % shards == s, F.col("rows")).otherwise(0)) for s in range(shards)]
    start = cells.groupBy("hub").agg(F.array(*counts).alias("n"), F.sum("rows").alias("members")).where("members > 1").drop("members")
    labels = propagate_labels(start, quota, rounds)
    # what a start over the quota has put into a shard too many stays open, as unlinked nodes are
    parts = labels.select("hub", F.posexplode("n").alias("shard", "rows")).where("rows > 0")
    kept = _before(parts, "shard", "rows", "hub").withColumn("rows", F.greatest(F.least(F.get(_numbers(quota), F.col("shard")) - F.col("before"), F.col("rows")), F.lit(0)))
    dealt = kept.where("rows > 0").groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("shard", "rows"))).alias("parts"))  # a part a shard
    upto = F.transform("parts", lambda p, i: F.struct(F.aggregate(F.slice("parts", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x.rows).alias("upto"), p.shard.alias("shard")))
    dealt = scratch(dealt.select(F.col("hub").alias("d_hub"), upto.alias("upto")), "dealt")
    ahead = W.partitionBy("hub").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    based = cells.join(dealt, F.col("hub") == F.col("d_hub")).select(F.col("hub").alias("c_hub"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("base"), "upto")
    inner = W.partitionBy("hub", "cell").orderBy(*ids)
    ranked = salted.withColumn("inside", F.row_number().over(inner) - 1)
    placed = ranked.join(based, (F.col("hub") == F.col("c_hub")) & (F.col("cell") == F.col("c_cell")), "left")
    own = F.filter("upto", lambda p: F.col("base") + F.col("inside") < p.upto)
    placed = scratch(placed.select(*nodes.columns, F.get(own, F.lit(0))["shard"].alias("shard")), "placed")
    room = list(quota)
    for r in placed.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a shard
        room[r["shard"]] -= r["n"]
    # the others close the gaps: the k-th of them goes where the k-th free place is
    rest = salted_rank(placed.where("shard is null").drop("shard"), [], ids, "at", 16 * SALTS)
    ends = F.array(*[F.struct(F.lit(sum(room[: s + 1])).cast("long").alias("end"), F.lit(s).alias("shard")) for s in range(shards)])
    rest = rest.select(*nodes.columns, F.get(F.filter(ends, lambda e: F.col("at") < e.end), F.lit(0))["shard"].alias("shard"))
    return placed.where("shard is not null").unionByName(rest)


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 30) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null) per document.

    Documents of equal text are linked (by SHA-256 of the text). Null texts have size 1 and no
    links; empty ones are equal; long ones are digested whole. Null ids and repeated rows each
    take a slot; other columns are ignored; an empty table gives none. Slots are gapless from 0
    within a shard, by salted ranks.
    """
    t = F.col("text").cast("string")
    nodes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(t, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(F.encode(t, "UTF-8"), 256)).alias("hub"),
    )
    put = propagate(scratch(nodes, "nodes"), shards, rounds)
    slotted = salted_rank(put.drop("hub"), ["shard"], ["doc_id", "size", "text_crc32"], "slot", 4 * SALTS)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
