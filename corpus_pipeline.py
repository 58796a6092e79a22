"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows of its
predecessor; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postresp.llm.bpe import bpe_encode
from postresp.llm.common import passing_tables, stored, table
from postresp.llm.mixing import mixed_texts
from postresp.llm.near_dup import deduplicated
from postresp.llm.quality_rules import quality_filter
from postresp.llm.suffix_dedup import cut_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject low-quality documents; remove lines too common on their host (operator 10)."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group (operator 7)."""
    return deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages from all but their first place (operator 1)."""
    return cut_texts(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share of words; a text is what the mix takes of it (operator 5)."""
    return mixed_texts(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, checked by decoding them again (operator 9)."""
    return bpe_encode(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("bpe_encoding", encoding),
]

#: minhash candidates and pseudorandom draws have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing_tables(spark):     # what a stage writes on its way goes when its result is written
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
