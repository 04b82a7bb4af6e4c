"""The corpus pipeline: documents through filtering, deduplication, decontamination and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import decontam, linededup, packing, quality, simhash
from terrace.llm.common import scratch_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on labelled rows of the source table, outside the
    held-out fifth."""
    source = table(spark, sf_dir, "documents")
    return quality.keep_good(docs, quality.fit_quality(source, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an equal or near line precedes. ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    out = linededup.without_repeated_lines(docs, short=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: The stages use XXH64, a trained network and a tokenizer, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
