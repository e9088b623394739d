"""The corpus pipeline: documents to packed training sequences.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir) and returns a DataFrame;
each result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import settled, table
from lodestrata.llm.line_dedup import dedup_lines
from lodestrata.llm.near_dedup import one_of_each
from lodestrata.llm.packing import pack
from lodestrata.llm.pii import redact
from lodestrata.llm.quality import keep_good


def _recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where it is a column, as the text now has."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; documents stay, if need be with an empty text."""
    return _recounted(dedup_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that fingerprints or shared shingles link, the one with the smallest id stays."""
    return one_of_each(docs, words=5, percent=80, reach=4)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _recounted(redact(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, none across documents."""
    return pack(docs, with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", pack_stage),
]

#: The stages run trained models, fingerprints and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
