"""Queries on the running of a collection, and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import changes, ops
from lodestrata.operators.corpus import classify_domain
from lodestrata.plans._registry import query
from lodestrata.plans._tables import hours
from lodestrata.session import table

TYPES = ["signup", "purchase", "view", "click", "error", "refund"]
NOW = "2024-01-31 00:00:00"
DOMAINS = {"law": ["license", "copyright"], "tone": ["idiot", "moron", "worthless", "pathetic"], "prose": ["the ", "und ", "les ", "los "]}
TYPES_SQL = "(SELECT unnest(['signup', 'purchase', 'view', 'click', 'error', 'refund']) AS event_type)"


@query("coverage_summary", f"SELECT t.event_type, count(e.event_id) AS n, round(count(e.event_id) / (SELECT count(*) FROM events), 3) AS share FROM {TYPES_SQL} t LEFT JOIN events e USING (event_type) GROUP BY 1")
def coverage_summary(spark, d):  # noqa: ANN001, ANN201
    return ops.counts_of_all(table(spark, d, "events"), "event_type", TYPES)


@query(
    "domain_coverage",
    """
    WITH x AS (SELECT doc_id, lang, lower(text) AS t,
        (contains(lower(text), 'license'))::INT + (contains(lower(text), 'copyright'))::INT AS a,
        (contains(lower(text), 'idiot'))::INT + (contains(lower(text), 'moron'))::INT + (contains(lower(text), 'worthless'))::INT + (contains(lower(text), 'pathetic'))::INT AS b,
        (contains(lower(text), 'the '))::INT + (contains(lower(text), 'und '))::INT + (contains(lower(text), 'les '))::INT + (contains(lower(text), 'los '))::INT AS c FROM documents),
    y AS (SELECT *, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN NULL WHEN a >= b AND a >= c THEN 'law' WHEN b >= c THEN 'tone' ELSE 'prose' END AS domain FROM x)
    SELECT coalesce(domain, 'none') AS domain, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang <> 'en') AS n_other,
        round(count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS en_share FROM y GROUP BY 1
    """,
)
def domain_coverage(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").withColumn("domain", F.coalesce(classify_domain(F.lower("text"), DOMAINS), F.lit("none")))
    en = F.count_if(F.col("lang") == "en")
    return docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), en.alias("n_en"), F.count_if(F.col("lang") != "en").alias("n_other"), F.round(en / F.count(F.lit(1)), 4).alias("en_share"))


@query("weighted_coverage", "WITH g AS (SELECT l_returnflag AS flag, avg(l_discount) AS v, count(*) AS w FROM lineitem GROUP BY 1) SELECT round(sum(v * w) / sum(w), 4) AS weighted, arg_min(flag, (v, flag)) AS weakest FROM g")
def weighted_coverage(spark, d):  # noqa: ANN001, ANN201
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("v"), F.count(F.lit(1)).alias("w"))
    return ops.weighted_average(g, "v", "w", "flag")


@query("last_success", "SELECT user_id, max(ts) AS last_run, max(CASE WHEN event_type IN ('purchase', 'signup') THEN ts END) AS last_success FROM events GROUP BY 1")
def last_success(spark, d):  # noqa: ANN001, ANN201
    return ops.last_success(table(spark, d, "events"), "user_id", "event_type", ["purchase", "signup"], "ts")


@query(
    "source_freshness",
    f"""
    WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_success FROM events GROUP BY 1), c AS (SELECT unnest(range(0, 200)) AS user_id),
    a AS (SELECT c.user_id, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_success)) / 3600000000.0, 4) AS age_hours FROM c LEFT JOIN s USING (user_id))
    SELECT user_id, age_hours, age_hours IS NULL OR age_hours > 72 AS stale FROM a
    """,
)
def source_freshness(spark, d):  # noqa: ANN001, ANN201
    done = ops.last_success(table(spark, d, "events"), "user_id", "event_type", ["purchase"], "ts").select("user_id", "last_success")
    configured = spark.range(200).select(F.col("id").alias("user_id"))
    return ops.freshness(configured, done, "user_id", F.lit(NOW).cast("timestamp"), F.lit(72)).select("user_id", "age_hours", "stale")


@query("heartbeat", f"SELECT user_id FROM events GROUP BY 1 HAVING coalesce((epoch_us(TIMESTAMP '{NOW}') - max(epoch_us(CASE WHEN event_type = 'signup' THEN ts END))) / 3600000000.0 > 120, true)")
def heartbeat(spark, d):  # noqa: ANN001, ANN201
    done = ops.last_success(table(spark, d, "events"), "user_id", "event_type", ["signup"], "ts")
    return ops.freshness(done.select("user_id"), done, "user_id", F.lit(NOW).cast("timestamp"), F.lit(120)).where("stale").select("user_id")


@query(
    "due_anti",
    """
    WITH s AS (SELECT user_id, (extract(hour FROM ts) * 60 + extract(minute FROM ts))::INT AS m FROM events WHERE ts::DATE = DATE '2024-01-10'),
    p AS (SELECT user_id, max(m) AS latest FROM s WHERE m <= 900 GROUP BY 1),
    done AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = DATE '2024-01-10' AND event_type IN ('purchase', 'view'))
    SELECT user_id, 'window' AS why FROM p WHERE 900 - latest <= 30
    UNION ALL SELECT user_id, 'catch_up' FROM p WHERE 900 - latest > 30 AND user_id NOT IN (SELECT user_id FROM done)
    """,
)
def due_anti(spark, d):  # noqa: ANN001, ANN201
    today = table(spark, d, "events").where(F.to_date("ts") == F.lit("2024-01-10").cast("date"))
    scheduled = today.select("user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    done = today.where(F.col("event_type").isin("purchase", "view")).select("user_id").distinct()
    return ops.due(scheduled, done, "user_id", "m", 900)


@query("cyclic_gap", "WITH t AS (SELECT DISTINCT user_id, (extract(hour FROM ts) * 60 + extract(minute FROM ts))::INT AS m FROM events), g AS (SELECT user_id, coalesce(lead(m) OVER (PARTITION BY user_id ORDER BY m), min(m) OVER (PARTITION BY user_id) + 1440) - m AS gap FROM t) SELECT user_id, max(gap) / 60 AS max_gap_hours FROM g GROUP BY 1")
def cyclic_gap(spark, d):  # noqa: ANN001, ANN201
    times = table(spark, d, "events").select("user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    return changes.cyclic_gap(times, "user_id", "m")


@query("cadence_audit", "WITH t AS (SELECT DISTINCT user_id, (extract(hour FROM ts) * 60 + extract(minute FROM ts))::INT AS m FROM events), g AS (SELECT user_id, coalesce(lead(m) OVER (PARTITION BY user_id ORDER BY m), min(m) OVER (PARTITION BY user_id) + 1440) - m AS gap FROM t), x AS (SELECT user_id, max(gap) / 60 AS max_gap_hours FROM g GROUP BY 1) SELECT user_id, max_gap_hours, 3.0 AS budget, max_gap_hours <= 3.0 AS ok, max_gap_hours * 2 <= 6 AS survives_one_failure FROM x")
def cadence_audit(spark, d):  # noqa: ANN001, ANN201
    return ops.cadence_audit(cyclic_gap(spark, d), F.lit(6.0))


@query("percentile_cadence", "WITH x AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0 AS h FROM events), y AS (SELECT user_id, list_sort(list(h)) AS l FROM x WHERE h IS NOT NULL GROUP BY 1) SELECT user_id, round(l[1 + least((len(l) * 0.5)::INT - CASE WHEN (len(l) * 0.5)::INT > len(l) * 0.5 THEN 1 ELSE 0 END, len(l) - 1)], 4) AS p50, round(l[1 + least(floor(len(l) * 0.9)::INT, len(l) - 1)], 4) AS p90, len(l) AS n FROM y")
def percentile_cadence(spark, d):  # noqa: ANN001, ANN201
    gaps = changes.intervals(table(spark, d, "events"), "user_id", "ts", "event_id")
    found = changes.index_percentile(gaps, ["user_id"], "hours", {"p50": 0.5, "p90": 0.9})
    return found.select("user_id", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"), "n")


@query(
    "percentiles_of_all",
    "WITH x AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN v END) AS p50, max(CASE WHEN i = least(floor(n * 0.9), n - 1) THEN v END) AS p90, max(CASE WHEN i = n - 1 THEN v END) AS most, max(n) AS n FROM x",
)
def percentiles_of_all(spark, d):  # noqa: ANN001, ANN201
    return changes.index_percentile(table(spark, d, "lineitem"), [], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "most": 1.0})


@query("age_buckets", "SELECT CASE WHEN a <= 365 THEN '1y' WHEN a <= 730 THEN '2y' WHEN a <= 1460 THEN '4y' ELSE 'older' END AS bucket, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM (SELECT DATE '2001-12-31' - o_orderdate::DATE AS a, o_totalprice FROM orders) GROUP BY 1")
def age_buckets(spark, d):  # noqa: ANN001, ANN201
    a = F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate"))
    bucket = F.when(a <= 365, "1y").when(a <= 730, "2y").when(a <= 1460, "4y").otherwise("older")
    return table(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


@query("pivot_signals", "SELECT lang, count(*) FILTER (WHERE contains(text, '|')) AS bars, count(*) FILTER (WHERE NOT contains(text, '|')) AS plain FROM documents GROUP BY 1")
def pivot_signals(spark, d):  # noqa: ANN001, ANN201
    signal = F.when(F.contains("text", F.lit("|")), "bars").otherwise("plain")
    return table(spark, d, "documents").withColumn("signal", signal).groupBy("lang").pivot("signal", ["bars", "plain"]).count().na.fill(0)


@query("count_and_distinct", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def count_and_distinct(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("top_hosts", "SELECT source, count(*) AS n FROM documents WHERE contains(text, 'anea') GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_hosts(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(F.contains("text", F.lit("anea"))).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("weekday_sets", "SELECT user_id AS facility, event_type AS meal, string_agg(DISTINCT dayofweek(ts)::VARCHAR, ',' ORDER BY dayofweek(ts)::VARCHAR) AS weekdays FROM events GROUP BY 1, 2")
def weekday_sets(spark, d):  # noqa: ANN001, ANN201
    return hours(spark, d).groupBy("facility", "meal").agg(F.array_join(F.sort_array(F.collect_set(F.col("weekday").cast("string"))), ",").alias("weekdays"))


@query("complete_coverage", "WITH x AS (SELECT user_id AS facility, event_type, count(DISTINCT dayofweek(ts)) AS w FROM events GROUP BY 1, 2) SELECT facility, bool_and(w = 7) AS complete FROM x GROUP BY 1")
def complete_coverage(spark, d):  # noqa: ANN001, ANN201
    per_meal = hours(spark, d).where(F.col("weekday").between(0, 6)).groupBy("facility", "meal").agg(F.count_distinct("weekday").alias("w"))
    return per_meal.groupBy("facility").agg(F.bool_and(F.col("w") == 7).alias("complete"))


@query("observation_span", "SELECT user_id AS facility, count(*) AS n, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day FROM events GROUP BY 1")
def observation_span(spark, d):  # noqa: ANN001, ANN201
    return hours(spark, d).groupBy("facility").agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("first_day"), F.max("valid_from").alias("last_day"))


@query("crawl_progress", "SELECT user_id, max(ts) AS last_run, CASE WHEN arg_max(event_type, (ts, event_id)) IN ('purchase', 'view') THEN 'finished' ELSE 'unfinished' END AS state FROM events GROUP BY 1")
def crawl_progress(spark, d):  # noqa: ANN001, ANN201
    return ops.progress(table(spark, d, "events"), "user_id", "ts", F.col("event_type").isin("purchase", "view")).select("user_id", "last_run", "state")


@query("unfinished_resume", f"SELECT user_id, min(ts) AS resume_at FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR GROUP BY 1")
def unfinished_resume(spark, d):  # noqa: ANN001, ANN201
    recent = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("ts") > F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 48 HOURS")))
    return recent.groupBy("user_id").agg(F.min("ts").alias("resume_at"))


@query("block_alerts", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') AND user_id % 3 = 0 THEN 'lifted' WHEN NOT bool_or(event_type = 'purchase') AND user_id % 3 <> 0 THEN 'newly_blocked' WHEN NOT bool_or(event_type = 'purchase') THEN 'known' ELSE 'fine' END AS state FROM events WHERE ts::DATE = DATE '2024-01-12' GROUP BY user_id")
def block_alerts(spark, d):  # noqa: ANN001, ANN201
    probes = table(spark, d, "events").where(F.to_date("ts") == F.lit("2024-01-12").cast("date")).withColumn("ok", F.col("event_type") == "purchase")
    return ops.block_alerts(probes, "user_id", "ok", F.col("user_id") % 3 == 0).select("user_id", "state")


@query("probe_verdict", "SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'all' WHEN bool_or(event_type = 'purchase') THEN 'some' WHEN bool_or(event_type = 'view') THEN 'page_only' ELSE 'none' END AS verdict FROM events GROUP BY 1")
def probe_verdict(spark, d):  # noqa: ANN001, ANN201
    kind = F.col("event_type")
    verdict = F.when(F.bool_and(kind != "error"), "all").when(F.bool_or(kind == "purchase"), "some").when(F.bool_or(kind == "view"), "page_only").otherwise("none")
    return table(spark, d, "events").groupBy("user_id").agg(verdict.alias("verdict"))


@query("metric_history", "SELECT event_id, user_id, ts, value FROM events WHERE user_id = 3 AND event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 10")
def metric_history(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").where("user_id = 3 and event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "ts", "value").limit(10)


@query("keyword_union_count", "SELECT count(DISTINCT doc_id) AS docs, count(*) AS hits FROM documents JOIN (SELECT unnest(['license', 'copyright', 'idiot', 'token =']) AS k) ON contains(lower(text), k)")
def keyword_union_count(spark, d):  # noqa: ANN001, ANN201
    words = ["license", "copyright", "idiot", "token ="]
    met = F.explode(F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(w)) for w in words)))).alias("k")
    return table(spark, d, "documents").select("doc_id", met).agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("hits"))


@query("table_totals", "SELECT 'sections' AS kind, sum(len(string_split(text, chr(10))))::BIGINT AS n FROM documents UNION ALL SELECT 'notices', count(*) FROM orders UNION ALL SELECT 'posts', count(*) FROM conversations")
def table_totals(spark, d):  # noqa: ANN001, ANN201
    one = lambda t, kind: table(spark, d, t).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    lines = table(spark, d, "documents").agg(F.lit("sections").alias("kind"), F.sum(F.size(F.split("text", "\n"))).alias("n"))
    return lines.unionByName(one("orders", "notices")).unionByName(one("conversations", "posts"))
