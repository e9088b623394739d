"""Sheets: columns bound by header name, rows judged one by one; prices as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.dates import flexible_date
from lodestrata.functions.hashes import post_key
from lodestrata.operators.validate import first_failure


class MissingHeader(ValueError):
    """The sheet lacks a column that must be there."""


def read_sheet(spark: SparkSession, path: str, headers: dict[str, str], needed: list[str]) -> DataFrame:
    """A CSV with a header row; ``headers`` names the column for each header text.

    White space and what stands in brackets don't count in headers, nor does a byte order mark.
    Columns that aren't named are dropped, and a missing needed one is an error.
    """
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("multiLine", "true").option("escape", '"').csv(path)
    bound = {}
    for name in raw.columns:
        clean = "".join(name.lstrip("﻿").split()).split("(")[0]
        if clean in headers:
            bound[headers[clean]] = name
    if absent := [c for c in needed if c not in bound]:
        raise MissingHeader(f"missing: {', '.join(absent)}")
    return raw.select(*(F.col(f"`{name}`").alias(c) for c, name in bound.items()))


def posts(rows: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Rows with published_at, title and body as posts, and those set apart with the reason."""
    published, title = flexible_date(F.col("published_at"), year), F.trim("title")
    keyed = rows.withColumns({"published_at": published, "title": title, "post_key": post_key(published, title)})
    reason = first_failure([("no_title", F.coalesce(title, F.lit("")) != ""), ("no_date", F.col("published_at").isNotNull())])
    judged = keyed.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def price(shown: Column) -> Column:
    """A price text as a struct: text, min, max; an open end or a single price has no max."""
    digits = F.transform(F.regexp_extract_all(F.replace(shown, F.lit(","), F.lit("")), F.lit(r"(\d{3,})")), lambda n: n.try_cast("int"))
    closed = (F.size(digits) > 1) & ~F.regexp_like(shown, F.lit("부터|from"))
    return F.struct(shown.alias("text"), F.array_min(digits).alias("min"), F.when(closed, F.array_max(digits)).alias("max"))
