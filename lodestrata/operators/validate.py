"""Validation: rules in order, the first that fails names the reason; bad rows are set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_LEAST, PRICE_MOST = 500, 20_000
SHARPEST_CHANGE = 0.7


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row fails; null if it passes all.  A rule whose condition is
    null fails."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules))


def split_by(rows: DataFrame, reason: Column, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those that don't with the reason; none is lost."""
    judged = rows.withColumn(name, reason)
    return judged.where(F.col(name).isNull()).drop(name), judged.where(F.col(name).isNotNull())


def meal_rules(meals: list[str], states: list[str], most_items: int = 40, shortest: int = 1, longest: int = 60, spaces: int = 5) -> list[tuple[str, Column]]:
    """Rules for a service: columns meal_type, service_status, date, zone, corner, items (names)."""
    items, operating = F.col("items"), F.col("service_status") == "operating"
    one_blob = (F.size(items) == 1) & (F.char_length(F.try_element_at(items, F.lit(1))) - F.char_length(F.replace(F.try_element_at(items, F.lit(1)), F.lit(" "), F.lit(""))) >= spaces)
    return [
        ("meal_type", F.col("meal_type").isin(meals)),
        ("service_status", F.col("service_status").isin(states)),
        ("date", F.try_to_date(F.col("date"), "yyyy-MM-dd").isNotNull()),
        ("key", F.col("zone").isNotNull() & F.col("corner").isNotNull()),
        ("items_of_closed", operating | (F.size(items) == 0)),
        ("no_items", ~operating | (F.size(items) > 0)),
        ("too_many", F.size(items) <= most_items),
        ("name_length", F.forall(items, lambda n: F.char_length(n).between(shortest, longest))),
        ("one_blob", ~F.coalesce(one_blob, F.lit(False))),
        ("repeated", ~F.exists(F.array_distinct(items), lambda n: F.size(F.filter(items, lambda m: m == n)) > 2)),
    ]


def price_rules(text: Column, least: str, most: str) -> list[tuple[str, Column]]:
    low, high = F.col(least), F.col(most)
    return [
        ("no_text", F.trim(text) != ""),
        ("range", low.between(PRICE_LEAST, PRICE_MOST)),
        ("order", high.isNull() | (high >= low)),
        ("range_max", high.isNull() | high.between(PRICE_LEAST, PRICE_MOST)),
    ]


def anomaly(count: Column, previous: Column) -> Column:
    """Nothing after something, or a change of more than 70 %; null if neither or nothing came before."""
    change = F.abs(count - previous) / previous
    return F.when(previous.isNull() | (previous == 0), F.lit(None).cast("string")).when(count == 0, "empty").when(change > SHARPEST_CHANGE, "jump")


def anchor_gaps(rows: DataFrame, batch: str, day: str) -> DataFrame:
    """Of each batch the different gaps in days between its consecutive dates; aligned if all are one."""
    w = Window.partitionBy(batch).orderBy(day)
    gaps = rows.select(batch, day).distinct().withColumn("gap", F.datediff(F.col(day), F.lag(day).over(w)))
    return gaps.groupBy(batch).agg(
        F.sort_array(F.collect_set("gap")).alias("gaps"),
        F.count(F.lit(1)).alias("days"),
        F.coalesce(F.bool_and(F.col("gap") == 1), F.lit(True)).alias("aligned"),
    )


def mostly_outside(rows: DataFrame, batch: str, day: str, first_month: int, last_month: int) -> DataFrame:
    """Whether more than half of a batch's dates lie outside the months of its term."""
    off = ~F.month(day).between(first_month, last_month)
    return rows.groupBy(batch).agg(F.round(F.avg(off.cast("int")), 6).alias("off_share"), (F.avg(off.cast("int")) > 0.5).alias("misaligned"))


def same_items(left: Column, right: Column, normalize) -> Column:  # noqa: ANN001
    """Whether two readings of a cell give the same list, in order, after normalising."""
    return F.transform(left, normalize) == F.transform(right, normalize)
