"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. ``run`` writes
between stages under the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm.common import table
from fieldlake.llm.decontaminate import drop_leaks
from fieldlake.llm.language import known_language
from fieldlake.llm.line_dedup import dedup_lines
from fieldlake.llm.minhash import drop_duplicates
from fieldlake.llm.mixing import mix_sources
from fieldlake.session import cut_lineage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's own models know; those they reject go."""
    return known_language(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; n_chars is that of the shortened text."""
    kept = dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near-duplicates."""
    return drop_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of each document of which the mix takes words."""
    mixed = mix_sources(docs)
    return mixed.filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None  # language models and weighted samples are beyond SQL; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
