"""A corpus pipeline of five operators: each stage takes (spark, docs, sf_dir) and works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlore.llm.bpe import bpe_round_trip
from fieldlore.llm.minhash import deduplicate
from fieldlore.llm.mixing import mix_sources
from fieldlore.llm.queries import bucket, table, vocabulary
from fieldlore.llm.rules import keep_good
from fieldlore.llm.shared import fresh, save
from fieldlore.llm.toxicity import remove_toxic, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, with their columns, whatever these are called.

    Null and empty texts have too few words and go; whole texts of any length are read; repeated rows share a verdict; an empty table stays empty.
    """
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't call toxic, with their columns; it learns from the labels outside the held-out fold.

    Null and empty texts have the bias alone; repeated rows share a verdict, and count each time they are learnt from; an empty table stays empty, and
    where the labels don't have both classes, the more frequent one decides.
    """
    labels = table(spark, sf_dir, "labels").where(~F.coalesce(bucket(5) == 0, F.lit(False)))
    return remove_toxic(docs, *train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, with its columns.

    Documents without words link with nothing, rows without an id all stay, of repeated rows of one id one stays; an empty table stays empty.
    """
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks, once at least, with its columns.

    A null source is a source of its own; texts without words cost nothing; repeated rows of one id are used alike; an empty table stays empty.
    """
    (own,) = fresh("mix")
    return mix_sources(docs, prefix=own).drop(*(own + x for x in ("epoch", "block", "at")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, how many ids each whole text has, and digests of them and of what they decode to.

    Null and empty texts have no ids; repeated rows each get a row; an empty table gives none.
    """
    # a smaller table of words: the executors also hold what the stages before left in their heaps
    return bpe_round_trip(docs, vocabulary("word_bpe_49k.json"), table=100_000)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
#: Models and hashes of other kinds than SQL's: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
