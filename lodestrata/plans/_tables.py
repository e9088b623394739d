"""Stand-ins: the given tables in the shapes of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.corpus import sections
from lodestrata.session import table


def orders_as_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as facts: those with status F are verified, O awaiting, P quarantined."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderstatus") == "O", F.date_add(F.to_date("o_orderdate"), 90)).alias("valid_to"),
        F.when(F.col("o_orderstatus") == "P", "quarantined").when(F.col("o_orderstatus") == "O", "pending").otherwise("verified").alias("status"),
    )


def hours(spark: SparkSession, d: str) -> DataFrame:
    """Events as observed opening hours: facility, valid_from, weekday, meal, closed."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("facility"), F.to_date("ts").alias("valid_from"), (F.dayofweek("ts") - 1).alias("weekday"),
        F.col("event_type").alias("meal"), (F.col("event_type") == "error").alias("closed"), "event_id", "ts",
    )


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections(table(spark, d, "documents"))


SECTIONS_SQL = """
sec AS (
    SELECT doc_id AS page, source AS host, string_split(text, chr(10))[1] AS path,
        unnest(range(len(string_split(text, chr(10)))))::INT AS ordinal, unnest(string_split(text, chr(10))) AS text FROM documents
)"""
