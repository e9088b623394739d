"""Row numbers within groups whose size nobody knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored

LEAST_RANGES = 32


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``rows`` with their number, from 1, within equal ``keys`` in the given order: what a window of row
    numbers gives, without a group that is one task's work.

    Rows are dealt by ranges of keys and order together, so a large group lies in many ranges.  Each
    range is numbered by itself, and a group that began in an earlier range adds what it has there.
    Only the first group of a range can have begun before it, so there are fewer additions than ranges.

    Defined results: null keys are a group; rows alike in keys and order lie in one range and are
    numbered in any order; an empty table gives an empty result; other columns are kept, one of the name ``name`` is replaced.
    """
    spark = rows.sparkSession
    ranges = ranges or max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    taken = {c.lower() for c in rows.columns} | {name.lower()}
    part, before = (next(c for k in range(len(taken) + 1) if (c := f"_{word}{k}") not in taken) for word in ("range", "before"))
    dealt = rows.repartitionByRange(ranges, *(F.col(k).asc_nulls_first() for k in keys), *order).withColumn(part, F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn(before, F.sum(before).over(earlier)).where(F.col(before) > 0)  # less rows than ranges
    carried = carried.select(*(F.col(k).alias(f"{before}_{n}") for n, k in enumerate(keys)), F.col(part).alias(f"{before}_in"), before)
    same = F.col(part) == F.col(f"{before}_in")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{before}_{n}"))
    own = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order)).cast("long")
    joined = dealt.withColumn(name, own).join(F.broadcast(carried), same, "left")
    return joined.withColumn(name, F.col(name) + F.coalesce(before, F.lit(0))).select(*rows.columns, *(() if name in rows.columns else (name,)))
