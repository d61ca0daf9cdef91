"""The registered queries of the thirteen operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bytepairs, chat, decontaminate, jaccard, packing, passages, phrases, quality, runs, secrets, sharding, tokens, toxicity
from strandloom.session import ship

#: Files of public tokenizers; the names can be any that ``public_tokenizers.path`` knows.
COUNT_VOCABULARY, PACK_TOKENIZER, BYTE_RANKS = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokens.sentencepiece_vocabulary(tokenizer_path(COUNT_VOCABULARY))
    return tokens.token_counts(table(spark, sf_dir, "documents"), pieces)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = F.lit("</s>[INST] ok [/INST]")
    # conversation -1 is made with DataFrame functions alone
    row = lambda turn, role: F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), control.alias("text"))
    extra = spark.range(1).select(F.explode(F.array(row(0, "user"), row(1, "assistant"))).alias("r")).select("r.*")
    return chat.chat_digest(chat.chat_windows(turns.unionByName(extra)))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), tails=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytepairs.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_substring_dedup, op3_quality_rules, op4_jaccard_join, op5_decontamination, op6_toxicity, op7_best_fit_packing, op8_chat_formatting, op9_secret_scans, op10_sharding, op11_periodic_runs, op12_phrase_collocations, op13_byte_pairs, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from strandloom.llm.oracles import ORACLES

    return dict(ORACLES)
