"""Running the collection: coverage, freshness, what is due, progress, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEARTBEAT_HOURS = 24


def counts_of_all(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows and share of each listed value, zero where there is none."""
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = listed.join(F.broadcast(counts.where(F.col(column).isin(values))), column, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    n = total.first()["total"]
    return out.withColumn("share", F.round(F.col("n") / F.nullif(F.lit(n), F.lit(0)), 3))


def weighted_average(rows: DataFrame, value: str, weight: str, label: str) -> DataFrame:
    """The weighted average of a value, and the label of its smallest."""
    return rows.agg(
        F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 4).alias("weighted"),
        F.min_by(label, F.struct(F.col(value), F.col(label))).alias("weakest"),
    )


def last_success(runs: DataFrame, key: str, outcome: str, good: list[str], stamp: str) -> DataFrame:
    return runs.groupBy(key).agg(
        F.max(stamp).alias("last_run"), F.max(F.when(F.col(outcome).isin(good), F.col(stamp))).alias("last_success")
    )


def freshness(sources: DataFrame, successes: DataFrame, key: str, now: Column, limit_hours: Column) -> DataFrame:
    """Age in hours of each configured source's last success; stale if over its limit or never."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_success").cast("timestamp"))) / F.lit(3_600_000_000.0)
    out = sources.join(successes, key, "left").withColumn("age_hours", F.round(age, 4))
    return out.withColumn("stale", F.col("age_hours").isNull() | (F.col("age_hours") > limit_hours))


def due(scheduled: DataFrame, done_today: DataFrame, key: str, minute: str, now_minute: int, window: int = 30) -> DataFrame:
    """Sources inside their window, or past it without a success today."""
    past = scheduled.where(F.col(minute) <= now_minute).groupBy(key).agg(F.max(minute).alias("latest"))
    inside = past.where(F.lit(now_minute) - F.col("latest") <= window).select(key, F.lit("window").alias("why"))
    missed = past.where(F.lit(now_minute) - F.col("latest") > window).join(done_today.select(key), key, "left_anti").select(key, F.lit("catch_up").alias("why"))
    return inside.unionByName(missed)


def cadence_audit(gaps: DataFrame, limit: Column) -> DataFrame:
    """Whether each source's longest gap is at most half its limit."""
    return gaps.withColumn("budget", limit / 2).withColumn("ok", F.col("max_gap_hours") <= limit / 2).withColumn("survives_one_failure", F.col("max_gap_hours") * 2 <= limit)


def progress(runs: DataFrame, key: str, stamp: str, finished: Column) -> DataFrame:
    """Each source's last run: finished or unfinished."""
    return runs.groupBy(key).agg(F.max(stamp).alias("last_run"), F.max_by(finished, F.struct(stamp, "event_id")).alias("done")).withColumn("state", F.when(F.col("done"), "finished").otherwise("unfinished"))


def block_alerts(probes: DataFrame, key: str, ok: str, known_blocked: Column) -> DataFrame:
    """lifted, newly_blocked, known or fine per source, by whether any probe came through."""
    found = probes.groupBy(key).agg(F.bool_or(ok).alias("any_ok"), F.bool_and(ok).alias("all_ok"), F.bool_or(known_blocked).alias("known"))
    state = F.when(F.col("any_ok") & F.col("known"), "lifted").when(~F.col("any_ok") & ~F.col("known"), "newly_blocked").when(~F.col("any_ok"), "known").otherwise("fine")
    return found.withColumn("state", state)
