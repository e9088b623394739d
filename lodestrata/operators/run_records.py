"""Job runs as rows: a wrapper that counts what a job writes while it writes, and records how it ended."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id string, source_key string, started_at timestamp, finished_at timestamp, outcome string, rows long, set_apart long, error string"
MOST_ERROR_CHARS = 200


def recorded(spark: SparkSession, runs: str, source_key: str, job: Callable[[], DataFrame], write: Callable[[DataFrame], None], apart: Column | None = None, now: dt.datetime | None = None) -> dict:
    """Run ``job`` through ``write`` and append one row below ``runs``: success, quarantine (if rows hold ``apart``) or error.

    An error is recorded and raised again.  ``write`` is given the job's rows as they are; they are counted on their way.
    """
    started, seen = now or dt.datetime.now(dt.UTC), Observation()
    row = {"run_id": f"{source_key}-{started:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}", "source_key": source_key, "started_at": started}

    def enter(outcome: str, rows: int | None, set_apart: int | None, error: str | None) -> dict:
        whole = row | {"finished_at": max(started, dt.datetime.now(dt.UTC)), "outcome": outcome, "rows": rows, "set_apart": set_apart, "error": error}
        spark.createDataFrame([tuple(whole.values())], RUNS).coalesce(1).write.mode("append").parquet(runs)
        return whole

    try:
        counted = job().observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(False) if apart is None else apart).alias("apart"))
        write(counted)
        got = seen.get
    except Exception as failed:
        enter("error", None, None, f"{type(failed).__name__}: {failed}"[:MOST_ERROR_CHARS])
        raise
    return enter("quarantine" if got["apart"] else "success", got["rows"], got["apart"], None)


def last_runs(spark: SparkSession, runs: str) -> DataFrame:
    """Each source's newest run, and when it last succeeded."""
    table = spark.read.schema(RUNS).parquet(runs)
    columns = [c for c in table.columns if c != "source_key"]
    good = F.max(F.when(F.col("outcome") != "error", F.col("finished_at"))).alias("last_success")
    newest = table.groupBy("source_key").agg(F.max_by(F.struct(*columns), F.struct("started_at", "run_id")).alias("x"), good)
    return newest.select("source_key", "x.*", "last_success")
