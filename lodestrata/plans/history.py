"""Queries on histories: change logs, intervals, drift, margins, turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import changes, validate
from lodestrata.plans._registry import query
from lodestrata.plans._tables import hours
from lodestrata.session import table


@query("change_log", "SELECT user_id, ts, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def change_log(spark, d):  # noqa: ANN001, ANN201
    return changes.change_log(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id").select("user_id", "ts", "event_id", "event_type")


@query("change_intervals", "SELECT user_id, event_id, round(h, 6) AS hours FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0 AS h FROM events) WHERE h IS NOT NULL")
def change_intervals(spark, d):  # noqa: ANN001, ANN201
    return changes.intervals(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", F.round("hours", 6).alias("hours"))


@query(
    "set_drift",
    """
    WITH s AS (SELECT user_id AS facility, ts::DATE AS valid_from, list_sort(list(DISTINCT event_type)) AS i FROM events GROUP BY 1, 2),
    b AS (SELECT *, lag(i) OVER (PARTITION BY facility ORDER BY valid_from) AS p FROM s)
    SELECT facility, valid_from, array_to_string(list_sort(list_filter(i, lambda x: NOT list_contains(p, x))), ',') AS added,
        array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(i, x))), ',') AS removed FROM b WHERE p IS NOT NULL AND i <> p
    """,
)
def set_drift(spark, d):  # noqa: ANN001, ANN201
    found = changes.set_drift(hours(spark, d), "facility", "valid_from", "meal")
    return found.select("facility", "valid_from", *(F.array_join(F.sort_array(c), ",").alias(c) for c in ("added", "removed")))


@query("margin_ratio", "WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER w AS k, lead(n_chars) OVER w AS second FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)) SELECT source, doc_id, round(n_chars / second, 6) AS margin FROM r WHERE k = 1")
def margin_ratio(spark, d):  # noqa: ANN001, ANN201
    # A source may hold a third of all rows: the two best of each are found by aggregates, not by sorting it.
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    order = F.struct(F.col("n_chars").alias("n"), (-F.col("doc_id")).alias("back"))
    first = rows.groupBy("source").agg(F.max(order).alias("first")).select("source", F.col("first.n").alias("best"), (-F.col("first.back")).alias("best_id"))
    rest = rows.join(first.select("source", "best_id"), "source").where("doc_id <> best_id")
    second = rest.groupBy("source").agg(F.max("n_chars").alias("second"))
    both = first.join(second, "source", "left")
    return both.select("source", F.col("best_id").alias("doc_id"), F.round(F.col("best") / F.col("second"), 6).alias("margin"))


@query("representative_and_maximum", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k, max(length(text)) OVER (PARTITION BY source) AS most FROM documents) SELECT source, doc_id, most FROM r WHERE k = 1")
def representative_and_maximum(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "documents").groupBy("source")
    best = F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id")
    return rows.agg(best, F.max(F.char_length("text")).cast("long").alias("most"))


@query("rivals", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS k, first_value(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_custkey, o_orderkey, k AS place FROM r WHERE k BETWEEN 2 AND 5 AND o_totalprice >= 0.7 * top")
def rivals(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, d, "orders").withColumn("place", F.row_number().over(w)).withColumn("top", F.first("o_totalprice").over(w))
    return rows.where("place between 2 and 5 and o_totalprice >= 0.7 * top").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("tie_census", "SELECT n_same, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY source, n_chars) AS n_same FROM documents) GROUP BY 1")
def tie_census(spark, d):  # noqa: ANN001, ANN201
    # Counting per (source, n_chars) first makes the census an aggregate of aggregates.
    sizes = table(spark, d, "documents").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n_same"))
    return sizes.groupBy("n_same").agg((F.count(F.lit(1)) * F.col("n_same")).alias("n"))


@query("round_robin", "WITH s AS (SELECT source, min(doc_id) AS seen FROM documents GROUP BY 1), r AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars, d.doc_id) AS turn, s.seen FROM documents d JOIN s USING (source)) SELECT doc_id, source, turn, seen FROM r")
def round_robin(spark, d):  # noqa: ANN001, ANN201
    rows = changes.round_robin(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", [F.col("n_chars"), F.col("doc_id")], "doc_id")
    return rows.select("doc_id", "source", F.col("turn").cast("long").alias("turn"), "seen")


@query("anchor_gaps", "WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM x) SELECT user_id, count(*) AS days, coalesce(bool_and(gap = 1), true) AS aligned, max(gap)::INT AS widest FROM g GROUP BY 1")
def anchor_gaps(spark, d):  # noqa: ANN001, ANN201
    found = validate.anchor_gaps(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day")
    return found.select("user_id", "days", "aligned", F.array_max("gaps").alias("widest"))


@query("article_groups", "WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), g AS (SELECT *, sum((length(line) < 20)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS article FROM l) SELECT doc_id, article::BIGINT AS article, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM g GROUP BY 1, 2")
def article_groups(spark, d):  # noqa: ANN001, ANN201
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = changes.article_groups(lines, "doc_id", "pos", F.char_length("line") < 20)
    return rows.groupBy("doc_id", "article").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line")).alias("chars"))


@query("first_seen_titles", "WITH x AS (SELECT doc_id, regexp_replace(trim(string_split(text, chr(10))[1]), '\\s+', ' ', 'g') AS title FROM documents) SELECT title, min(doc_id) AS doc_id FROM x GROUP BY 1")
def first_seen_titles(spark, d):  # noqa: ANN001, ANN201
    from lodestrata.functions.text import squeeze

    title = squeeze(F.element_at(F.split("text", "\n"), 1))
    return table(spark, d, "documents").groupBy(title.alias("title")).agg(F.min("doc_id").alias("doc_id"))


@query("page_hash", "WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sha256(string_agg(substr(sha256(line), 1, 16), '' ORDER BY pos)) AS page_hash FROM l GROUP BY 1")
def page_hash(spark, d):  # noqa: ANN001, ANN201
    from lodestrata.functions.hashes import ordered_hash

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    entry = F.struct("pos", F.substring(F.sha2("line", 256), 1, 16).alias("h"))
    return lines.groupBy("doc_id").agg(ordered_hash(F.collect_list(entry)).alias("page_hash"))


@query("anomaly_delta", "WITH x AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), y AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS p FROM x) SELECT user_id, day, n, 'jump' AS anomaly FROM y WHERE p IS NOT NULL AND abs(n - p) / p > 0.7")
def anomaly_delta(spark, d):  # noqa: ANN001, ANN201
    counts = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    return counts.withColumn("anomaly", validate.anomaly(F.col("n"), F.lag("n").over(w))).where("anomaly is not null")
