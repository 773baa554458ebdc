"""The corpus pipeline: five stages from raw documents to packed token sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewright.llm.common import Scratch, crc_mod, read, small_batches
from vanewright.llm.lines import dedup_lines
from vanewright.llm.mixing import mix
from vanewright.llm.neardup import near_duplicates
from vanewright.llm.packing import pack
from vanewright.llm.toxicity import fit_toxicity, score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words in a generation of a worker's cache of token ids: executors hold what the stages before have left, so fewer than
#: where texts are only packed.
CACHE_ENTRIES = 200_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled documents of sf_dir."""
    small_batches(spark)
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    model = fit_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), labels)
    return score_toxicity(docs, model).where("not rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on three sites or more stay only where they come first; every document stays."""
    return dedup_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays. Rows with one doc_id are one
    document: they stay or go together. Rows without an id stay."""
    small_batches(spark)
    gone = Scratch(spark, "neardup-gone").save(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mixture, each as often as it is read."""
    chosen = mix(docs).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return chosen.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1024 tokens."""
    small_batches(spark)
    return pack(docs, entries=CACHE_ENTRIES)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Neither the classifier nor the tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
