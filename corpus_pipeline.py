"""A training-corpus pipeline over ``documents``: each stage is written as Parquet and read again.

1. ``toxicity``: documents whose score reaches the threshold of their language go.
2. ``near_duplicates``: one document of each group of near duplicates stays.
3. ``repeated_strings``: strings of 200 bytes and more that start at several places are cut
   out of the texts; every document stays, if need be with an empty text.
4. ``decontamination``: documents that cover half of a benchmark item or more go.
5. ``mixture``: documents are drawn, some several times, so that sources meet their target
   weights; ``mix_copy`` numbers the copies.

Nulls in any column, empty tables and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerscope.llm.common import Scratch
from answerscope.llm.decontamination import without_contaminated
from answerscope.llm.minhash_join import one_of_each_group
from answerscope.llm.mixing import mixed_rows
from answerscope.llm.suffix_dedup import remove_repeats
from answerscope.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
