"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination and encoding, each stage on what the last one kept.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, no rows, and columns beside those of documents,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, line_dedup, pieces, simhash, toxicity
from quire.llm.common import release, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the toxicity score accepts. Null and empty texts score like texts without matches and stay; equal texts fare alike."""
    return toxicity.acceptable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that occur, but for two edits, in an earlier place; n_chars follows a text that lost some.

    Every document stays, with an empty text if all its lines are repeats; null texts stay null. Of rows with equal id and text all
    lose the same lines; rows without an id come last.
    """
    out = line_dedup.dedup_lines(docs, names=("__n_lines", "__n_dropped", "__n_links"))
    return out.select(*(F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else out[c] for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Null texts, empty ones and those without words are one group;
    rows that repeat the kept id, and rows without an id, stay."""
    return simhash.first_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no passages of the benchmark beyond the rule's share. Null and empty texts have no words and stay; repeated rows
    fare alike; an empty benchmark drops nothing."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with sampled segmentations: the best one's ids and all their scores. Null and empty texts have the empty segmentation;
    equal rows have equal ones."""
    return pieces.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("encoding", encode),
]

#: Fitted models, edit distances and sampled segmentations have no SQL; tests hold each stage against a version of its own in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read again as the next one's input, which is deleted
    once the next one's rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = done
    return docs
