"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, documents that
hold a benchmark passage go, the rest is drawn to the target mixture, and what is kept
becomes token files.  All stages but the last return the columns of ``documents``.

Defined cases, as of the operators: a null or empty text is clean, alone and without
benchmark words, takes the chance of its mixture cell and becomes the end token; a null id
is kept by every filter that its text passes; rows that repeat an id stay or go together,
but for texts of several cells, of which the kept ones decide; texts of any length are read
whole; an empty table gives empty stages; further columns go through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm.common import write_table
from claimloom.llm.decontaminate import decontaminate
from claimloom.llm.mixing import draw_mixture
from claimloom.llm.near_dedup import keep_one
from claimloom.llm.queries import token_files
from claimloom.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # five-word shingles, a similarity of 0.8 or more; 16 tables miss a pair at 0.8 with a probability of 2e-5
    return keep_one(docs, percent=80, tables=16)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return draw_mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the classifier, the raking and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = write_table(stage(spark, docs, sf_dir), name)
    return docs
