"""Corpus pipeline: each stage takes what its predecessor kept and is written before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
that they were given. A null text counts as an empty one and passes the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from tidewatch.session import configure, fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, labels))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on several sites go, but for their first occurrence; no document goes."""
    return line_dedup.cleaned(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the words that the mix takes of each document; documents it takes nothing of go."""
    return mixing.with_portions(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate),
          ("near_dedup", drop_near_copies), ("decontamination", drop_leaks),
          ("mixing", mix_sources)]
ORACLE_SQL = None  # a trained score cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and reread."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"pipeline-{name}")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
