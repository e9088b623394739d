"""Histories: change logs, intervals, drift of sets, schedules and their gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranking import numbered
from lodestrata.session import stored


def change_log(rows: DataFrame, key: str, stamp: str, value: str, tie: str) -> DataFrame:
    """Rows whose value differs from the one before under the same key, the first included."""
    w = Window.partitionBy(key).orderBy(stamp, tie)
    return rows.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def intervals(rows: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """Hours since the row before under the same key."""
    w = Window.partitionBy(key).orderBy(stamp, tie)
    hours = (F.unix_micros(F.col(stamp).cast("timestamp")) - F.unix_micros(F.lag(stamp).over(w).cast("timestamp"))) / F.lit(3_600_000_000.0)
    return rows.withColumn("hours", hours).where("hours is not null")


def set_drift(rows: DataFrame, key: str, day: str, item: str) -> DataFrame:
    """Per key and day what was added to and removed from the day observed before; no row if nothing."""
    sets = rows.groupBy(key, day).agg(F.sort_array(F.collect_set(item)).alias("items"))
    w = Window.partitionBy(key).orderBy(day)
    both = sets.withColumn("before", F.lag("items").over(w)).where("before is not null")
    out = both.select(key, day, F.array_except("items", "before").alias("added"), F.array_except("before", "items").alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def cyclic_gap(times: DataFrame, key: str, minute: str, period: int = 1440) -> DataFrame:
    """Per key the longest gap in hours between times of a cycle, the one over its end included."""
    w = Window.partitionBy(key).orderBy(minute)
    whole = Window.partitionBy(key)
    nxt = F.coalesce(F.lead(minute).over(w), F.min(minute).over(whole) + period)
    return times.select(key, minute).distinct().withColumn("gap", nxt - F.col(minute)).groupBy(key).agg((F.max("gap") / 60).alias("max_gap_hours"))


def index_percentile(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by index: the value at place int(n * share) of the sorted values."""
    if not keys:
        return _percentile_of_all(rows, value, shares)
    w, n = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(n))
    picks = [F.max(F.when(F.col("_i") == F.least((F.col("_n") * share).cast("int"), F.col("_n") - 1), F.col(value))).alias(name) for name, share in shares.items()]
    return placed.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias("n"))


def _percentile_of_all(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Different values with their counts in ranges; the sums of the ranges say in which one a place lies, and only that is looked through."""
    spark = rows.sparkSession
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranges = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(counted.repartitionByRange(ranges, F.col(value).asc_nulls_first()).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sorted(map(tuple, placed.groupBy("_part").agg(F.sum("_c")).collect()))  # a row a range
    n, picked = sum(c for _, c in sums), {}
    for name, share in shares.items():
        left = min(int(n * share), n - 1)
        for part, count in sums:
            if left < count:
                running = F.sum("_c").over(Window.orderBy(F.col(value).asc_nulls_first()))
                picked[name] = placed.where(F.col("_part") == part).withColumn("_to", running).where(F.col("_to") > left).agg(F.min_by(F.struct(value), "_to")[value]).first()[0]
                break
            left -= count
    kind = dict(rows.dtypes)[value]
    return spark.createDataFrame([(*(picked.get(name) for name in shares), n)], ", ".join(f"{name} {kind}" for name in shares) + ", n long")


def round_robin(rows: DataFrame, group: str, order: list[Column], first_seen: str) -> DataFrame:
    """Rows with their turn: the first of every group, then the second of every group...  A large group is numbered in many tasks."""
    seen = rows.groupBy(F.col(group).alias("_group")).agg(F.min(first_seen).alias("seen"))
    turns = numbered(rows, [group], order, "turn")
    return turns.join(seen, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def article_groups(lines: DataFrame, doc: str, pos: str, is_header: Column) -> DataFrame:
    """Lines with the number of the article they belong to: headers seen so far in the document."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("article", F.sum(is_header.cast("int")).over(w))
