"""Queries on decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import decisions
from lodestrata.plans._registry import query
from lodestrata.session import table

ASKED_SQL = """
h AS (SELECT user_id AS facility, ts::DATE AS valid_from, dayofweek(ts) AS weekday, CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS meal,
    CASE event_id % 3 WHEN 0 THEN 'unspecified' WHEN 1 THEN 'spring' ELSE 'autumn' END AS term, event_type = 'error' OR event_id % 5 = 0 AS closed FROM events),
q AS (SELECT DISTINCT user_id AS facility, DATE '2024-01-17' AS day, 'view' AS meal, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'spring' ELSE 'autumn' END AS term FROM events),
m AS (SELECT q.facility, q.day, max(h.valid_from) AS valid_from FROM q JOIN h ON h.facility = q.facility AND h.valid_from <= q.day GROUP BY 1, 2),
r AS (SELECT q.facility, q.term AS asked, h.term, count(*) FILTER (WHERE h.meal IN ('', q.meal)) AS deciding, bool_or(h.closed AND h.meal IN ('', q.meal)) AS any_closed
    FROM q JOIN m USING (facility) JOIN h ON h.facility = q.facility AND h.valid_from = m.valid_from WHERE h.weekday = dayofweek(q.day) GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN deciding = 0 THEN NULL ELSE NOT any_closed END AS verdict FROM r),
g AS (SELECT facility, asked, coalesce(bool_or(term = asked), false) AS has_own, bool_or(CASE WHEN term = asked THEN verdict END) AS own,
    bool_or(term = 'unspecified') AS has_loose, bool_or(CASE WHEN term = 'unspecified' THEN verdict END) AS loose, bool_and(term = 'unspecified') AS only_loose,
    count(*) FILTER (WHERE term <> 'unspecified') AS concrete, count(*) FILTER (WHERE term <> 'unspecified' AND verdict) AS yes,
    count(*) FILTER (WHERE term <> 'unspecified' AND verdict IS NULL) AS unknown FROM v GROUP BY 1, 2),
a AS (SELECT q.facility, q.term, m.valid_from IS NOT NULL AS observed, g.*, (q.facility % 4 = 0) AS complete FROM q LEFT JOIN m USING (facility) LEFT JOIN g ON g.facility = q.facility),
s AS (SELECT facility, CASE WHEN NOT observed THEN NULL WHEN has_own IS NULL THEN CASE WHEN complete THEN false END
    WHEN term IS NOT NULL THEN CASE WHEN has_own THEN coalesce(own, CASE WHEN complete THEN false END)
        WHEN has_loose THEN CASE WHEN loose IS NULL THEN CASE WHEN complete THEN false END WHEN loose THEN NULL ELSE false END
        WHEN complete THEN false END
    WHEN only_loose THEN CASE WHEN loose IS NULL THEN CASE WHEN complete THEN false END WHEN loose THEN NULL ELSE false END
    WHEN concrete > 0 AND yes = 0 AND (unknown = 0 OR complete) THEN false END AS serves FROM a)"""


def served(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    term = F.when(F.col("event_id") % 3 == 0, "unspecified").when(F.col("event_id") % 3 == 1, "spring").otherwise("autumn")
    hours = e.select(
        F.col("user_id").alias("facility"), F.to_date("ts").alias("valid_from"), (F.dayofweek("ts") - 1).alias("weekday"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type")).alias("meal"), term.alias("term"),
        ((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0)).alias("closed"),
    )
    u = e.select(F.col("user_id").alias("facility")).distinct()
    asked_term = F.when(F.col("facility") % 3 == 1, "spring").when(F.col("facility") % 3 == 2, "autumn")
    asked = u.select("facility", F.lit("2024-01-17").cast("date").alias("day"), F.lit("view").alias("meal_asked"), asked_term.alias("term_asked"))
    return decisions.serves(asked, hours, u.withColumn("complete", F.col("facility") % 4 == 0))


@query("serves_decision", f"WITH {ASKED_SQL} SELECT facility, serves FROM s")
def serves_decision(spark, d):  # noqa: ANN001, ANN201
    return served(spark, d).select("facility", "serves")


@query(
    "answer_branch",
    f"""
    WITH {ASKED_SQL}, x AS (SELECT user_id AS facility, count(*) AS n, max(ts) < TIMESTAMP '2024-01-29' AS stale, bool_or(event_type = 'purchase') AS items, bool_and(event_type = 'error') AS shut
        FROM events WHERE event_type <> 'signup' GROUP BY 1)
    SELECT s.facility, CASE WHEN coalesce(n, 0) > 0 AND stale THEN 'C-2' WHEN coalesce(n, 0) = 0 THEN CASE WHEN serves IS NULL THEN 'C-2' WHEN serves THEN 'C-1' ELSE 'B' END
        WHEN items THEN 'A' WHEN shut THEN 'B' WHEN serves IS NULL THEN 'C-2' WHEN serves THEN 'C-1' ELSE 'B' END AS branch FROM s LEFT JOIN x USING (facility)
    """,
)
def answer_branch(spark, d):  # noqa: ANN001, ANN201
    kind = F.col("event_type")
    seen = table(spark, d, "events").where("event_type <> 'signup'").groupBy(F.col("user_id").alias("facility")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("ts") < F.lit("2024-01-29").cast("timestamp_ntz")).alias("stale"),
        F.bool_or(kind == "purchase").alias("items"), F.bool_and(kind == "error").alias("shut"),
    )
    both = served(spark, d).join(seen, "facility", "left")
    no = F.lit(False)
    out = decisions.branch(F.coalesce("n", F.lit(0)) > 0, F.coalesce("stale", no), F.coalesce("items", no), F.coalesce("shut", no), F.col("serves"))
    return both.select("facility", out.alias("branch"))


@query("answer_verdicts", "SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'rightly_deferred' WHEN quality = 0 THEN 'wrong' WHEN toxic = 1 THEN 'deferred' WHEN doc_id % 2 = 0 THEN 'right' ELSE 'wrong' END AS verdict FROM labels")
def answer_verdicts(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "labels")
    expected = F.when(F.col("quality") == 0, "defer").otherwise("answer")
    found = F.when(F.col("quality") == 0, F.col("toxic") == 1).otherwise(F.col("toxic") == 0)
    return rows.select("doc_id", decisions.answer_verdict(expected, found, F.col("doc_id") % 2 == 0).alias("verdict"))


@query("bottlenecks", "SELECT source, CASE WHEN bool_or(contains(string_split(text, chr(10))[1], 'anea')) THEN 'search' WHEN bool_or(contains(text, 'anea')) THEN 'body_only' ELSE 'coverage' END AS lost_at FROM documents GROUP BY 1")
def bottlenecks(spark, d):  # noqa: ANN001, ANN201
    word = F.lit("anea")
    title, text = F.bool_or(F.contains(F.element_at(F.split("text", "\n"), 1), word)), F.bool_or(F.contains("text", word))
    return table(spark, d, "documents").groupBy("source").agg(decisions.bottleneck(title, text, text).alias("lost_at"))


@query("manual_states", "SELECT CASE WHEN o_totalprice < 5000 THEN 'empty' WHEN o_orderstatus <> 'O' THEN 'no_expiry' WHEN o_orderdate::DATE + 90 < DATE '1998-06-01' THEN 'expired' ELSE 'ready' END AS state, count(*) AS n FROM orders GROUP BY 1")
def manual_states(spark, d):  # noqa: ANN001, ANN201
    text = F.when(F.col("o_totalprice") < 5000, " ").otherwise("x")
    to = F.when(F.col("o_orderstatus") == "O", F.date_add(F.to_date("o_orderdate"), 90))
    state = decisions.manual_state(text, to, F.lit("1998-06-01").cast("date"))
    return table(spark, d, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("clarify_effect", "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS recovered, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS regressed, count(*) FILTER (WHERE quality = 1 AND toxic = 0) - count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS net FROM labels")
def clarify_effect(spark, d):  # noqa: ANN001, ANN201
    up, down = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1))
    return table(spark, d, "labels").agg(up.alias("recovered"), down.alias("regressed"), (up - down).alias("net"))
