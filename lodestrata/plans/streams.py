"""Queries on streams, each equal to its batch form."""

from __future__ import annotations

from lodestrata.plans._registry import query
from lodestrata.streaming import events


def _events(spark, d):  # noqa: ANN001, ANN202
    return events.event_stream(spark, f"{d}/events.parquet")


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):  # noqa: ANN001, ANN201
    return events.drained(events.tumbling(_events(spark, d)), "complete").selectExpr("cast(start as timestamp_ntz) start", "event_type", "n", "total")


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1")
def stream_sliding(spark, d):  # noqa: ANN001, ANN201
    return events.drained(events.sliding(_events(spark, d)), "complete").selectExpr("cast(start as timestamp_ntz) start", "n")


@query("stream_session", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s")
def stream_session(spark, d):  # noqa: ANN001, ANN201
    return events.drained(events.sessions(_events(spark, d)), "complete").selectExpr("user_id", "cast(start as timestamp_ntz) start", "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):  # noqa: ANN001, ANN201
    return events.drained(events.deduplicated(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("stream_change_log", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def stream_change_log(spark, d):  # noqa: ANN001, ANN201
    return events.drained(events.change_log(_events(spark, d)), "append")
