"""State in tables: upserts, replacements and quarantine as new versions of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows replace those of the same key; of new rows of one key the first in order stands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_listed(current: DataFrame, new: DataFrame, keys: list[str], listed: list[str], sticky: tuple[str, ...] = ()) -> DataFrame:
    """As ``upsert``, but of existing rows only listed columns change; a sticky one keeps its value
    where the new one is null."""
    renamed = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_is_new"))
    both = current.withColumn("_is_old", F.lit(True)).join(renamed, keys, "full_outer")
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in sticky:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
        elif c in listed:
            out.append(F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_is_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
    return both.select(*out)


def replace_partitions(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Everything under a key that the new rows touch is replaced."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of keys that aren't there yet."""
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti").dropDuplicates(keys))


def sync(current: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table as the new rows have it, and the rows that go."""
    return new, current.join(new.select(*keys), keys, "left_anti")


def grow_schema(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return current.unionByName(new, allowMissingColumns=True)


def added_columns(current: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns that are missing, as nulls of their type."""
    return current.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in current.columns})


def unchanged(new: DataFrame, last: DataFrame, key: str, digest: str) -> DataFrame:
    """New rows whose content differs from the last good one of their key."""
    return new.join(last.select(key, digest), [key, digest], "left_anti")


def quarantined(rows: DataFrame, reason: Column) -> DataFrame:
    """Rows with a reason change their status; none is deleted."""
    return rows.withColumn("status", F.when(reason.isNotNull(), "quarantined").otherwise(F.col("status")))
