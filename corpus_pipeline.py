"""The corpus pipeline: documents in, encoded training mix out.

Each stage works on all that its predecessor kept; its rows are written as
Parquet in the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.exact_dedup import keep_first
from quire.llm.mixing import mixed_rows
from quire.llm.ngram_join import keep_one_of_group
from quire.llm.quality import keep_good
from quire.llm.sentencepiece_spans import encode_digests
from quire.session import stored
from quire.sources.papers import load_table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality classifier rejects go."""
    return keep_good(docs, load_table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the smallest id stays."""
    return keep_first(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies the smallest id stays."""
    return keep_one_of_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    return mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: ids and decoded text of every row, as digests."""
    return encode_digests(docs)


STAGES = [("quality classifier", good), ("exact dedup", unique), ("n-gram Jaccard join", distinct),
          ("mixing to target weights", mixed), ("SentencePiece encoding", encoded)]

#: The classifier and the mix cannot be said in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
