"""A corpus from `documents`: toxicity, line dedup, near-dedup, decontamination, mix.

Every stage takes (spark, docs, sf_dir) and returns documents, the last one with
a row per repetition.  A stage judges all rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import copies, decontam, lines, mixing, toxicity
from loomstone.llm.shared import cleaned, fold, made, removed, scratch

#: SQL can't express Kneser-Ney models, components of copies or seeded samples.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by models of labelled rows whose crc32 modulo 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 5) != 0)
    return toxicity.kept(docs, toxicity.fit(docs, labels))


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows the text.  No document goes."""
    out = lines.deduplicated(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs at 0.8 or more of their five-word runs connect; SimHash and MinHash find the pairs."""
    return copies.one_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every repetition that the mix takes of a document: its columns, and copy (from 1)."""
    return mixing.repeated(docs)


STAGES = [("toxicity", without_toxic), ("line dedup", without_templates), ("near-dedup", without_copies), ("decontamination", without_leaks), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on `documents`; each one's result is written to the shared folder and read again.

    Models and other files of a stage are removed once its result is written, and so
    is the result before it; the last one's stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        before = made(spark)
        stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{k}")
        cleaned(spark, before)
        docs = spark.read.parquet(path)
        if k:
            removed(spark, f"{at}/{k - 1}")
    return docs
