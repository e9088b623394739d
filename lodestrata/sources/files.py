"""Snapshots and plain files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.hashes import content_hash, stable_hash

SNAPSHOT = "source_key string, url string, fetched_at timestamp, http_status int, media_type string, content binary"


def save_snapshots(results: DataFrame, path: str) -> None:
    """Raw contents by source, each with both hashes; the stable one names the snapshot."""
    named = results.withColumns({"content_hash": content_hash(F.col("content")), "stable_hash": stable_hash(F.col("content").cast("string"))})
    named.withColumn("snapshot_id", F.concat_ws(":", "source_key", F.substring("stable_hash", 1, 16))).write.mode("append").partitionBy("source_key").parquet(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def last_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each source."""
    order = F.struct("fetched_at", "snapshot_id")
    columns = [c for c in snapshots.columns if c != "source_key"]
    return snapshots.groupBy("source_key").agg(F.max_by(F.struct(*columns), order).alias("s")).select("source_key", "s.*")


def usage(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files and bytes under a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, plain or gzip: path and html."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_json_weeks(spark: SparkSession, path: str) -> DataFrame:
    """A weekly menu service's nested JSON as rows: restaurant, date, day, category and items."""
    schema = "status string, list array<struct<restNm: string, date: string, day: int, subData: array<struct<cate1: string, cate2: string, cate3: string, diet: string>>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    days = raw.select("status", F.explode("list").alias("d")).select("status", "d.*")
    return days.select("status", F.col("restNm").alias("restaurant"), F.try_to_date("date", "yyyy-MM-dd").alias("date"), "day", F.explode_outer("subData").alias("s")).select("status", "restaurant", "date", "day", "s.*")


def accepted(payloads: DataFrame, now: Column, most_bytes: int = 5_000_000, oldest_hours: int = 48) -> DataFrame:
    """Pushed contents (base64) with why they are refused: undecodable, too large, too old, from the future."""
    content = F.try_to_binary("content", F.lit("base64"))
    age = (F.unix_micros(now) - F.unix_micros("fetched_at")) / F.lit(3_600_000_000.0)
    reason = (
        F.when(content.isNull(), "undecodable").when(F.octet_length(content) > most_bytes, "too_large").when(age < -0.1, "future").when(age > oldest_hours, "too_old")
    )
    return payloads.withColumns({"bytes": content, "reason": reason})


def variants(sources: DataFrame, year: str, back: int, ahead: int, semesters: list[int]) -> DataFrame:
    """What to fetch of each source: the years around its own, each with all semesters, each once; none without a year."""
    around = F.sequence(F.col(year) - back, F.col(year) + ahead)
    spread = sources.where(F.col(year).isNotNull()).withColumn("ac_year", F.explode(around)).withColumn("ac_semester", F.explode(F.array(*map(F.lit, semesters))))
    return (spread if year == "ac_year" else spread.drop(year)).distinct()


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a byte order mark in front of the first column's name and quotes doubled, as spreadsheets expect it."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"﻿{first}").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
