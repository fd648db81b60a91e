"""From raw documents to packed batches: five operators, one after another.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
:func:`run` writes as Parquet and reads again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``; other columns of
the input go. An empty table goes through all of them. Null ids, languages and
sources are values like others, rows may repeat, texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkset.llm import mixing, packing, pii, quality, simhash
from linkset.plans.workspace import Workspace

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them;
    repeated rows share one verdict."""
    return quality.keep_good(docs.select(DOC_COLUMNS), Workspace(spark, label="quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest id (null last), then the
    smallest hash of the text. Repeated rows, and all null and empty texts, are one group."""
    return simhash.keep_one(docs.select(DOC_COLUMNS), Workspace(spark, label="simhash"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, ``n_chars`` follows. Every
    row stays; a null text stays null."""
    return pii.masked(docs.select(DOC_COLUMNS), Workspace(spark, label="pii"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of repeated rows, each for itself. A
    text without words adds nothing to a target; its key decides as for others."""
    return mixing.mixed(docs.select(DOC_COLUMNS), Workspace(spark, label="mix"))


def length_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their length bucket, batch and slot: every row once, null texts with
    length 0; which of two equal lengths comes first is open."""
    return packing.pack(docs, Workspace(spark, label="pack"), ["doc_id", "text"])


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("pii", private_data),
    ("source_mix", source_mix),
    ("length_batches", length_batches),
]

#: Fingerprints, bootstrapped patterns and the length buckets are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; intermediate tables go to the shared folder."""
    files = Workspace(spark, label="corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = files.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
