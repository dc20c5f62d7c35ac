"""The corpus pipeline: documents to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor
kept. All but the last return the columns of ``documents``. ``run`` keeps every stage's result as
Parquet in the shared folder, so a lost executor costs at most the stage at hand.

1. quality rules: documents that break a rule go.
2. line dedup: boilerplate lines of a source go; documents stay.
3. SimHash near-dedup: of documents whose five-word shingles are 0.8 or more alike one stays.
   SimHash finds candidates, an exact join finds the rest, each pair is checked on whole sets.
4. source mixing: documents are repeated or left out to reach the target weights.
5. packing: documents are cut into sequences along a Hilbert curve.

A document without a source is of one source of its own; null and empty texts do not pass the
first stage. Columns beyond those of ``documents`` pass through the first four stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallybridge.llm import lines, mixing, packing, quality, shingles
from tallybridge.llm.registry import reachable, table
from tallybridge.session import shared_dir

# Hashing, tokenising and the Hilbert order are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return shingles.kept_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return packing.packed(docs, packing.vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("source mix", source_mix),
    ("curve packing", curve_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; every stage but the last is written and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
