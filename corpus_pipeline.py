"""The training-text pipeline: drop poor texts, drop toxic texts, keep one text of each group of near copies, pack.

Every stage reads texts whole, however long, and takes null and empty texts and rows with null ids like others: the classifiers
score them by what they lack, the near-copy stage keeps all texts without words, packing gives them a piece of 0 tokens.
Equal texts get equal scores, so repeated rows stay or go together in the first two stages; the third keeps one of them. Of
equally good rows of a group of near copies the smallest id stays, nulls last. All but the last stage return the columns of
``docs``, whatever further ones there are and however they are called. An empty table stays empty. Without labels the
quality stage keeps all texts, and the toxicity stage goes by its fixed voters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larderflow.llm import ngram_join, packing, quality, toxicity
from larderflow.session import written

# A learnt classifier and sequential packing are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier accepts (score of 0.3 and more)."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity classifier does not call toxic (score below 0.3)."""
    return toxicity.accepted(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts linked by shingle similarity the one with the smallest id."""
    return ngram_join.distinct_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text lies: doc_id, piece, start, n_tokens, shard, bin."""
    return packing.best_fit(docs)


STAGES = [("quality", drop_poor), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
