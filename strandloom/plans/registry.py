"""Where queries and their SQL are registered, and what they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, n: int = 6) -> Column:
    """Doubles are rounded: sums run in another order in SQL. -0 becomes 0."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def written(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads back, in the shared checkpoint folder."""
    path = f"{shared_folder(spark)}/strandloom-files/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def as_text(df: DataFrame, path: str, sep: str = "\t") -> str:
    """Write the columns of ``df`` as lines of text; the path."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in df.columns]).alias("value")).write.text(path)
    return path
