"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.records import read_records, write_records

    _, manifest = write_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return read_records(spark, manifest)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def bucket(n: int):
    """crc32 of the id as text, modulo n; 0 to n - 1, and null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.language import predict, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(bucket(4) == 2, F.lit(False)))
    names, model = train(docs.where(~F.col("held_out")))
    return predict(docs, names, model, keep=["doc_id", "held_out"])


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.rules import cascade

    return cascade(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.toxicity import score, train

    held = F.coalesce(bucket(5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    slot, machine = train(docs, table(spark, sf_dir, "labels").where(~held))
    return score(docs.withColumn("held_out", held), slot, machine, keep=["doc_id", "held_out"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_at")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.lm import ORDER, score, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(bucket(10) == 0, F.lit(False)))
    return score(docs, train(docs.where(~F.col("held_out")), order=ORDER), keep=["doc_id", "held_out"])


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldlore.llm.vectors import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_mixing": op2_mixing, "op4_minhash": op4_minhash, "op3_records": op3_records, "op5_token_counts": op5_token_counts, "op6_language": op6_language, "op7_rules": op7_rules, "op8_toxicity": op8_toxicity, "op9_ngram_trie": op9_ngram_trie, "op10_vectors": op10_vectors}


def oracle_sql() -> dict[str, str]:
    from fieldlore.llm import rules

    return {"op7_rules": rules.ORACLE_SQL}
