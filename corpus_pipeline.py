"""Documents to packed training sequences, one operator of ``tidemark.llm`` a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as benchmark_passages
from tidemark.llm import line_dedup as repeated_lines
from tidemark.llm import minhash, packing
from tidemark.llm import toxicity as toxic_texts
from tidemark.llm.common import table, written
from tidemark.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on the labels scores 0.5 or more go."""
    model = toxic_texts.train(docs, table(spark, sf_dir, "labels"))
    return toxic_texts.drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the document with the smallest id."""
    shorter = repeated_lines.dedup_lines(docs).select(*docs.columns)
    return shorter.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles stays."""
    return minhash.drop_near_duplicates(docs, shingle_words=5, numerator=80, denominator=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside benchmark passages go."""
    return benchmark_passages.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 4096."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the classifier, nor the signatures, nor the linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
