"""The corpus pipeline: quality rules, language ID, exact dedup, near duplicates, packing.

Each stage is a function of (session, documents so far, folder of tables). All but the last return the columns of
`documents`. `run` writes what a stage returns to the shared folder and reads it back as the next one's documents.

Rows are judged by id and text together, so repeated ids lose nothing: of rows that are the same in both one stays after
exact dedup, and an id with several texts is several rows. Null ids are ids like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, language, near, packing, quality
from factloom.llm.queries import BYTES
from factloom.llm.store import new_path, released

ORACLE_SQL = None
BATCH = 1_000  # rows that the JVM and its Python workers hand each other at once: both hold a batch of whole texts, in each task, on the way there and back
KEEP = 200_000  # words that a worker of the packing stage remembers: other stages' workers live beside it


def small_batches(spark: SparkSession) -> None:
    """Each stage says so, as its rows are written later, by whoever calls it. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the likelihood ratio reject go."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in none of the learned languages go; a language that is NULL becomes the one that was found."""
    small_batches(spark)
    return language.keep_known(docs, language.fit(docs, ~language.held_out()))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts one row stays."""
    small_batches(spark)
    return near.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece."""
    small_batches(spark)
    return packing.pack(docs, *BYTES, keep=KEEP)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. A stage's own tables are removed once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        with released():
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
