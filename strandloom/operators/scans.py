"""Scans in order of position that spread one key over tasks: blocks, their summaries, carries.

A key's rows are cut into blocks by position. What a row needs of earlier or later rows lies in its
own block, or in a summary of the others: a block gives its sum, first and last position, and the
summaries are scanned by key. They are few (a block has 65,536 positions), so a key with all rows of the
table still costs its tasks a block each, and one small task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import settled

#: Positions of a block; blocks that are composed at a time.
BLOCK, FAN = 1 << 16, 64


def scanned(df: DataFrame, key: str, at: str, gap: int | None = None, width: int | None = BLOCK) -> DataFrame:
    """Adds ``before`` and ``after``, the neighbours' ``at`` by key (null at the ends), and ``upto``: the
    row's number by key, or with ``gap`` that of its group, as a step over ``gap`` starts one.

    ``at`` is a long, unique in its key. ``width`` None: keys are known to be short, so each is one block.
    """
    new = lambda before: F.when(before.isNull(), 0).when(F.lit(False) if gap is None else F.col(at) - before <= gap, 0).otherwise(1)
    if width is None:
        by = W.partitionBy(key).orderBy(at)
        near = df.withColumns({"before": F.lag(at).over(by), "after": F.lead(at).over(by)})
        return near.withColumn("upto", F.sum(new(F.col("before"))).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) + 1)
    # read twice, by rows and by blocks: made once
    blocked = settled(df.drop("before", "after", "upto").withColumn("__b", F.floor(F.col(at) / width)))
    by = W.partitionBy(key, "__b").orderBy(at)
    inner = blocked.withColumns({"__prev": F.lag(at).over(by), "__next": F.lead(at).over(by)})
    inner = inner.withColumn("__new", new(F.col("__prev")))
    blocks = inner.groupBy(key, "__b").agg(F.sum("__new").alias("__all"), F.min(at).alias("__first"), F.max(at).alias("__last"))
    order = W.partitionBy(key).orderBy("__b")
    blocks = blocks.withColumns({"__p": F.lag("__last").over(order), "__n": F.lead("__first").over(order)})
    # a block's first row starts a group, or goes on with that of the block before
    opens = F.when(F.col("__p").isNull(), 1).when(F.lit(False) if gap is None else F.col("__first") - F.col("__p") <= gap, 0).otherwise(1)
    ahead = F.coalesce(F.sum(F.col("__all") + F.col("__opens")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = blocks.withColumn("__opens", opens).select(key, "__b", "__p", "__n", (ahead + F.col("__opens")).alias("__carry"))
    upto = F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    both = inner.withColumn("__sum", upto).join(carry, [key, "__b"])
    return both.select(*[c for c in blocked.columns if c != "__b"], F.coalesce("__prev", "__p").alias("before"), F.coalesce("__next", "__n").alias("after"), (F.col("__sum") + F.col("__carry")).alias("upto"))


def tiles(df: DataFrame, key: str, seq: str, overlap: int, size: int = BLOCK) -> DataFrame:
    """key, tile (from 0), text: stretches of ``size`` characters with ``overlap`` more of the next, dealt to
    tasks. Each sequence is cut in one pass."""
    cut = df.select(key, F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("cut"))
    tail = F.transform("cut", lambda x, i: F.concat(x, F.coalesce(F.substring(F.get("cut", i + 1), 1, overlap), F.lit(""))))
    parts = cut.select(key, F.posexplode(tail).alias("tile", "text")).select(key, F.col("tile").cast("long").alias("tile"), "text")
    return parts.repartition(key, "tile")


_TABLE = "array<int>"


def entries(tables: DataFrame, starts: DataFrame, key: str, most: int, fan: int = FAN) -> DataFrame:
    """key, block, entry: the state in which each block is entered; -1 once all is over.

    ``tables``: key, block, f (array: state left in by state entered in, -1 for over); ``starts``: key,
    block, entry of each key's first block. Functions of ``fan`` neighbours are composed to one until a key
    has at most ``fan`` of them (``most``: blocks of the longest key), then entries are handed down again:
    rounds grow with the logarithm of the blocks, a group never holds more than ``fan`` tables.
    """
    levels = [tables.select(key, "block", "f")]
    while most > fan:
        most = -(-most // fan)
        levels.append(_composed(levels[-1].withColumn("sup", F.floor(F.col("block") / fan)), key))
    sup = starts
    for _ in levels[1:]:
        sup = sup.withColumn("block", F.floor(F.col("block") / fan))
    # the topmost: all blocks of a key in one group
    down = _entered(levels[-1].withColumn("sup", F.lit(0).cast("long")), starts=sup.select(key, F.lit(0).cast("long").alias("sup"), "entry"), key=key)
    for level in reversed(levels[:-1]):
        down = _entered(level.withColumn("sup", F.floor(F.col("block") / fan)), down.withColumnRenamed("block", "sup"), key)
    return down


def _composed(df: DataFrame, key: str) -> DataFrame:
    """key, block (the former ``sup``), f: the functions of a group one after the other."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        state = np.arange(len(pdf["f"].iloc[0]))
        for f in pdf["f"]:
            state = np.where(state < 0, -1, np.asarray(f)[state])
        return pd.DataFrame({key: pdf[key].iloc[:1], "block": pdf["sup"].iloc[:1], "f": [state.astype(np.int32)]})

    return df.groupBy(key, "sup").applyInPandas(run, f"{key} {kind}, block long, f {_TABLE}")


def _entered(df: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """key, block, entry of each block of a group (key, sup) that is entered in ``entry``."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        state, out = int(pdf["entry"].iloc[0]), []
        for f in pdf["f"]:
            out.append(state)
            state = -1 if state < 0 else int(f[state])
        return pd.DataFrame({key: pdf[key], "block": pdf["block"], "entry": out})

    return df.join(starts.select(key, "sup", "entry"), [key, "sup"]).groupBy(key, "sup").applyInPandas(run, f"{key} {kind}, block long, entry long")


def walked(blocks: DataFrame, schema: str, walk: Callable[..., Iterator[dict]]) -> DataFrame:
    """Rows that ``walk`` yields for each row of ``blocks``, a batch at a time."""
    full = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = list(walk(row))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return blocks.mapInArrow(run, full)
