"""Helpers the operators of this subpackage share: tables of a folder, and shared scratch space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import scratch, table

__all__ = ["free_name", "scratch", "settled", "table", "text_or_empty"]


WRITING = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")


def settled(df: DataFrame, name: str, by_hash: str = "0") -> DataFrame:
    """Write ``df`` once into shared space and read it back: cuts lineage, and a lost executor
    costs a read instead of the work before it.

    Meanwhile Spark deletes the shuffle files of the write as soon as it ends, and joins by hash
    instead of sorting where all partitions of a side turn out no larger than ``by_hash``.  That pays
    where a side has each key once; long runs of one key are read faster in order.
    """
    spark = df.sparkSession
    set_to = dict(zip(WRITING, ("true", by_hash), strict=True))
    path, before = scratch(spark, name), {key: spark.conf.get(key) for key in WRITING}
    try:
        for key, value in set_to.items():
            spark.conf.set(key, value)
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
