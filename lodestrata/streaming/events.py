"""Event streams from Parquet folders: windows with watermarks, dedup, and a change log in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.session import scratch


def _glob(path: str) -> str:
    """A pattern that matches ``path`` alone, which a file stream needs for a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def event_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Events as a stream; ``ts`` becomes an instant, for only instants can carry a watermark."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).options(**options).parquet(_glob(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def change_log(events: DataFrame) -> DataFrame:
    """user_id, event_id and event_type wherever a user's type differs from the one before.

    Rows of a user are ordered within each batch; the last one is the state the next batch begins
    from.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        before = rows.event_type.shift(1)
        before.iloc[0] = last
        changed = rows[(rows.event_type != before)]
        state.update((rows.event_type.iloc[-1],))
        yield changed[["user_id", "event_id", "event_type"]]

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, event_type string", "last string", "append", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and read what it gave."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
