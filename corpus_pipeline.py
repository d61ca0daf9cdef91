"""The corpus pipeline: five stages over documents, each written as Parquet and reread.

Every stage works on all documents that its predecessor kept, judged on its own input:
toxic documents go, one document of each near-duplicate class stays, documents that repeat
benchmark text go, secrets are masked in place, and what is left is packed.

All stages but the last return the columns of their input, in order, and read texts whole,
whatever their length. An empty table gives an empty one. What they do with null texts, null
ids and repeated rows is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the toxicity threshold.

    The model learns from labelled documents of this input. Each row is judged by itself: rows
    that repeat stay or go together, null texts count as empty, null ids don't matter.
    """
    from strandloom.llm import toxicity
    from strandloom.session import ship

    return toxicity.drop_toxic(docs, toxicity.train(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id.

    Rows that repeat a doc_id are one document, of which one row stays. Rows with a null id
    stay, as nothing tells them apart; so do null texts and texts without words.
    """
    from strandloom.llm import jaccard
    from strandloom.session import ship

    ship(spark)
    return jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no region that repeats benchmark text.

    Each row is judged by itself, one with a null id too; null texts stay.
    """
    from strandloom.llm import decontaminate
    from strandloom.session import ship

    return decontaminate.drop_contaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every found span of a secret replaced by a mark; null texts stay null."""
    from strandloom.llm import secrets
    from strandloom.session import ship

    ship(spark)
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: the tokens of all rows in sequences of at most 4096.

    Null texts count as empty (the end token alone); repeated rows and null ids are packed like others.
    """
    from strandloom.llm import packing, queries
    from strandloom.session import ship

    ship(spark)
    return packing.pack_documents(docs, queries.tokenizer_path(queries.PACK_TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express boosted trees, MinHash classes or alignments: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    from strandloom.llm.common import scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
