"""Two sources about the same things: comparing and merging them without inventing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(primary: DataFrame, secondary: DataFrame, keys: list[str], items: str, observed: str) -> DataFrame:
    """Each key of either source with both item lists and what became of it.

    match, conflict (both observed, different), primary_only, secondary_only, silent (neither
    observed anything).
    """
    left = primary.select(*keys, F.col(items).alias("primary_items"), F.col(observed).alias("primary_observed"))
    right = secondary.select(*keys, F.col(items).alias("secondary_items"), F.col(observed).alias("secondary_observed"))
    both = left.join(right, keys, "full_outer")
    p, s = (F.coalesce(F.col(c), F.lit(False)) for c in ("primary_observed", "secondary_observed"))
    result = (
        F.when(~p & ~s, "silent")
        .when(p & ~s, "primary_only")
        .when(~p & s, "secondary_only")
        .when(F.col("primary_items").eqNullSafe(F.col("secondary_items")), "match")
        .otherwise("conflict")
    )
    return both.withColumn("result", result)


def merge(compared: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: an observation beats silence, of two observations the primary stands."""
    takes_second = F.col("result") == "secondary_only"
    return compared.select(
        *keys,
        F.when(takes_second, F.col("secondary_items")).otherwise(F.coalesce("primary_items", "secondary_items")).alias("items"),
        F.when(takes_second | F.col("primary_items").isNull(), "secondary").otherwise("primary").alias("origin"),
        (F.col("result") == "conflict").alias("conflict"),
    )


def rates(compared: DataFrame) -> DataFrame:
    """Share of conflicts among what both observed, and of keys that only one observed."""
    is_ = lambda *names: F.col("result").isin(*names)
    both = F.count_if(is_("match", "conflict"))
    known = F.count_if(~is_("silent"))
    return compared.agg(
        F.round(F.count_if(is_("conflict")) / F.nullif(both, F.lit(0)), 6).alias("conflict_rate"),
        F.round(F.count_if(is_("primary_only", "secondary_only")) / F.nullif(known, F.lit(0)), 6).alias("gap_rate"),
    )


def noted(note: Column, conflict: Column, text: Column) -> Column:
    """A note with what the conflict was appended."""
    return F.when(conflict, F.concat_ws(" | ", F.nullif(note, F.lit("")), text)).otherwise(note)
