"""A training corpus from raw documents: five stages, each on what the one before it kept.

quality      documents whose perplexity is over their language's threshold go
exact        of documents with equal text but for white space, one row stays
near         of documents that shingle similarity links, one row stays: that with the smallest doc_id
repeats      byte strings that an earlier document has are cut out; documents of which nothing is left go
pack         what is left, tokenised and packed into sequences

Defined results: a null or empty text has no perplexity and stays, is equal to other empty texts (one row of all stays),
is similar to nothing, loses nothing, and is packed as its end token; a null doc_id never wins over a known one and counts
as the largest; of rows that repeat an id and a text one is left after the second stage, and rows that repeat an id
with different texts are judged by their texts; ties go to the smallest doc_id; empty tables pass through all stages;
other columns, whatever their names, stay with their rows until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import exact_dedup, jaccard, packing, quality, suffix_dedup
from trackloom.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_each(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text that is left."""
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact", one_of_equal), ("near", one_of_similar), ("repeats", without_repeats), ("pack", packed)]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
