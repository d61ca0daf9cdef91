"""Helpers shared by the training-data operators: scratch tables, ranks, components.

Everything here is DataFrame code; none of it starts a Python worker.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder for scratch tables where the cluster names none (tests on one machine).
LOCAL_SCRATCH = "/tmp/strandloom-checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where it is unset on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor rereads the files. They are removed when the
    application ends, as Spark may reread them until then.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/strandloom/{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(*dfs: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (Catalyst would inline it per use)."""
    return F.transform(F.array(value), body)[0]


def salted_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int = 256) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``keys``, without one task per key.

    Rows of a key are dealt to ``salts`` sub-groups by a hash of ``order``; sub-groups are
    counted (map-side), the counts are summed up in a table of at most keys x salts rows, and
    each row adds its rank inside its sub-group. ``order`` must identify a row; the order of
    the ranks is (salt, order). A key that holds all rows still spreads over ``salts`` tasks.
    """
    from pyspark.sql import Window as W

    salt, base = f"__{out}_salt", f"__{out}_base"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("__n"))
    # keys x salts rows: small whatever the input, so one window over them is no hot spot
    ahead = W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*keys, salt, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias(base))
    inner = W.partitionBy(*keys, salt).orderBy(*order)
    ranked = salted.withColumn(out, F.row_number().over(inner).cast("long") - 1)
    # null keys form a group of their own, as in groupBy
    left, right = ranked.alias("l"), bases.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on = F.col(f"l.{salt}") == F.col(f"r.{salt}")
    for s in same:
        on = on & s
    cols = [F.col(f"l.{c}") for c in df.columns if c != out]
    return left.join(right, on).select(*cols, (F.col(f"l.{out}") + F.col(f"r.{base}")).alias(out))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: columns a, b (long) -> node, component (its least node).

    Least-label propagation with pointer jumping; every round is one join and one map-side
    combined min per node, and is written to the shared checkpoint folder. No adjacency list
    is gathered, so a hub may hold any share of the edges. Nodes without an edge don't appear.
    """
    both = scratch(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .where("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct(),
        "edges",
    )
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        target = labels.select(F.col("node").alias("near"), F.col("component").alias("jump"))
        new = scratch(nearer.join(target, "near", "left").select("node", "old", F.least("near", "jump").alias("component")), "labels")
        changed = new.where("component <> old").limit(1).count()
        old, labels = labels, new.select("node", "component")
        drop_scratch(old)
        if not changed:
            drop_scratch(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
