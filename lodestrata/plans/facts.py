"""Queries on facts: guarded scans, validity, as-of sets, joins, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import facts as ops
from lodestrata.plans._registry import query
from lodestrata.plans._tables import SECTIONS_SQL, hours, orders_as_facts, page_sections
from lodestrata.session import table

DAY = "1998-06-01"
FACTS_SQL = """
f AS (
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate::DATE AS valid_from,
        CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE + 90 END AS valid_to,
        CASE o_orderstatus WHEN 'P' THEN 'quarantined' WHEN 'O' THEN 'pending' ELSE 'verified' END AS status FROM orders
)"""


@query("verified_scan", f"WITH {FACTS_SQL} SELECT o_orderkey, o_totalprice, valid_from FROM f WHERE status = 'verified' AND o_totalprice > 100000")
def verified_scan(spark, d):  # noqa: ANN001, ANN201
    return ops.facts(orders_as_facts(spark, d), F.col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice", "valid_from")


@query("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal")


@query("existence_probe", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def existence_probe(spark, d):  # noqa: ANN001, ANN201
    large = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("optional_filter", "SELECT 'all' AS asked, count(*) AS n FROM documents UNION ALL SELECT 'src3', count(*) FROM documents WHERE source = 'src3'")
def optional_filter(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents")
    count = lambda v: docs.where(ops.optional(v, "source")).agg(F.lit(v or "all").alias("asked"), F.count(F.lit(1)).alias("n"))
    return count(None).unionByName(count("src3"))


@query("validity_window", f"WITH {FACTS_SQL} SELECT o_orderkey, valid_from, valid_to FROM f WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')")
def validity_window(spark, d):  # noqa: ANN001, ANN201
    return orders_as_facts(spark, d).where(ops.valid_on(F.lit(DAY).cast("date"), "valid_from", "valid_to")).select("o_orderkey", "valid_from", "valid_to")


@query("deadline_open", f"WITH {FACTS_SQL} SELECT o_orderkey, valid_to FROM f WHERE valid_to IS NULL OR valid_to >= DATE '{DAY}'")
def deadline_open(spark, d):  # noqa: ANN001, ANN201
    return orders_as_facts(spark, d).where(ops.open_on(F.lit(DAY).cast("date"), "valid_to")).select("o_orderkey", "valid_to")


@query("expired_count", f"WITH {FACTS_SQL} SELECT count(*) FILTER (WHERE valid_to < DATE '{DAY}') AS expired, count(*) FILTER (WHERE NOT coalesce(valid_to < DATE '{DAY}', false)) AS open FROM f")
def expired_count(spark, d):  # noqa: ANN001, ANN201
    ok = ops.open_on(F.lit(DAY).cast("date"), "valid_to")
    return orders_as_facts(spark, d).agg(F.count_if(~ok).alias("expired"), F.count_if(ok).alias("open"))


@query("like_any", "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%worthless%' OR lower(text) LIKE '%license%' OR lower(source) LIKE '%worthless%' OR lower(source) LIKE '%license%'")
def like_any(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(ops.contains_any(["text", "source"], ["Worthless", "License"])).select("doc_id", "source")


@query("alias_without_longer", "SELECT doc_id FROM documents WHERE contains(text, 'thing') AND NOT (contains(text, 'things') OR contains(text, 'nothing'))")
def alias_without_longer(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(ops.contains_only("text", "thing", ["things", "nothing"])).select("doc_id")


@query("in_list", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def in_list(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("csv_membership", "SELECT p_partkey, p_name FROM part WHERE list_contains(list_transform(string_split(p_type || ', ' || p_brand, ','), lambda x: trim(x)), (SELECT min(p_brand) FROM part))")
def csv_membership(spark, d):  # noqa: ANN001, ANN201
    part = table(spark, d, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    joined = part.withColumn("categories", F.concat("p_type", F.lit(", "), "p_brand"))
    return joined.where(ops.in_list_field("categories", brand)).select("p_partkey", "p_name")


@query("fact_dimension_join", f"WITH {SECTIONS_SQL}, reg AS (SELECT DISTINCT source AS host, lang FROM documents) SELECT reg.lang, count(*) AS sections, count(DISTINCT sec.page) AS pages FROM sec JOIN documents x ON x.doc_id = sec.page JOIN (SELECT DISTINCT lang FROM reg) reg ON reg.lang = x.lang GROUP BY 1")
def fact_dimension_join(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "lang")
    return page_sections(spark, d).join(docs, "page").groupBy("lang").agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("page").alias("pages"))


@query("three_way_join", "SELECT n_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def three_way_join(spark, d):  # noqa: ANN001, ANN201
    items = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01'")
    s, n, p = (table(spark, d, t) for t in ("supplier", "nation", "part"))
    joined = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("n_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("nested_children", "SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS items, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_children(spark, d):  # noqa: ANN001, ANN201
    o, items = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem")
    nested = ops.with_children(o, items, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"], "items")
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return nested.select("o_orderkey", shown.alias("items"), F.size("items").cast("long").alias("n_items"))


@query(
    "price_join_ranked",
    """
    WITH r AS (
        SELECT p_brand AS name, p_retailprice AS price, p_partkey,
            row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_retailprice, p_partkey) AS k FROM part
        WHERE p_size <= 3
    )
    SELECT l.p_partkey, l.p_brand AS name, any_value(r.price) FILTER (WHERE r.k = 1) AS price, count(r.k) FILTER (WHERE r.k > 1) AS n_others
    FROM part l LEFT JOIN r ON r.name = l.p_brand WHERE l.p_size >= 45 GROUP BY l.p_partkey, l.p_brand
    """,
)
def price_join_ranked(spark, d):  # noqa: ANN001, ANN201
    part = table(spark, d, "part")
    # Large sizes are asked for against the price list of small ones.
    left = part.where("p_size >= 45").select("p_partkey", F.col("p_brand").alias("name"))
    right = part.where("p_size <= 3").select(F.col("p_brand").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("tie"), "p_type")
    rank = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    found = ops.ranked_exact_join(left, right, "name", rank, [F.col("price"), F.col("tie")], "price", F.col("tie").cast("string"))
    return found.select("p_partkey", "name", "price", F.size("others").cast("long").alias("n_others"))


@query("match_rate", "SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1.0 ELSE 0.0 END), 6) AS match_rate, count(*) AS total FROM customer")
def match_rate(spark, d):  # noqa: ANN001, ANN201
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("met", F.lit(1.0))
    both = table(spark, d, "customer").join(seen, "c_custkey", "left")
    return both.agg(F.round(F.avg(F.coalesce("met", F.lit(0.0))), 6).alias("match_rate"), F.count(F.lit(1)).alias("total"))


@query("asof_range_join", "SELECT o.o_orderkey, l.l_linenumber, l.l_shipdate::DATE AS shipped FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 30 DAY")
def asof_range_join(spark, d):  # noqa: ANN001, ANN201
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    within = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return o.join(items, (F.col("l_orderkey") == F.col("o_orderkey")) & within).select("o_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))


@query("asof_latest_set", "WITH h AS (SELECT user_id AS facility, ts::DATE AS valid_from, event_type AS meal, event_id FROM events WHERE ts::DATE <= DATE '2024-01-15'), m AS (SELECT facility, max(valid_from) AS valid_from FROM h GROUP BY 1) SELECT h.facility, h.valid_from, h.meal, h.event_id FROM h JOIN m USING (facility, valid_from)")
def asof_latest_set(spark, d):  # noqa: ANN001, ANN201
    return ops.latest_set(hours(spark, d), ["facility"], F.lit("2024-01-15").cast("date")).select("facility", "valid_from", "meal", "event_id")


@query(
    "interval_overlap",
    """
    WITH c AS (SELECT l_orderkey, min(l_shipdate)::DATE AS s, max(l_shipdate)::DATE AS e FROM lineitem GROUP BY 1),
    n AS (SELECT l_orderkey AS orderkey, s AS start_date, CASE WHEN e > s THEN e END AS end_date FROM c)
    SELECT * FROM n WHERE start_date <= DATE '1997-03-31' AND coalesce(end_date, start_date) >= DATE '1997-03-01'
    """,
)
def interval_overlap(spark, d):  # noqa: ANN001, ANN201
    spans = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("start_date"), F.to_date(F.max("l_shipdate")).alias("e"))
    spans = spans.select("orderkey", "start_date", F.when(F.col("e") > F.col("start_date"), F.col("e")).alias("end_date"))
    return spans.where(ops.overlaps(F.lit("1997-03-01").cast("date"), F.lit("1997-03-31").cast("date"), "start_date", "end_date"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark, d):  # noqa: ANN001, ANN201
    return ops.latest_per(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("semi_join_subquery", f"WITH {SECTIONS_SQL}, t AS (SELECT page, host FROM sec WHERE contains(lower(text), 'license')) SELECT host, count(*) AS sections, count(DISTINCT page) AS pages FROM sec WHERE page IN (SELECT page FROM t) GROUP BY 1")
def semi_join_subquery(spark, d):  # noqa: ANN001, ANN201
    rows = page_sections(spark, d)
    hits = rows.where(F.contains(F.lower("text"), F.lit("license"))).select("page")
    return rows.join(hits, "page", "left_semi").groupBy("host").agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("page").alias("pages"))


@query("anti_join_sync", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join_sync(spark, d):  # noqa: ANN001, ANN201
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def correlated_count(spark, d):  # noqa: ANN001, ANN201
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("quote_self_join", f"WITH {SECTIONS_SQL} SELECT a.page, a.ordinal, b.text AS quote FROM sec a LEFT JOIN sec b ON b.page = a.page AND b.ordinal = a.ordinal - a.ordinal % 5")
def quote_self_join(spark, d):  # noqa: ANN001, ANN201
    rows = page_sections(spark, d)
    quotes = rows.select("page", F.col("ordinal").alias("quote_ordinal"), F.col("text").alias("quote"))
    return rows.withColumn("quote_ordinal", F.col("ordinal") - F.col("ordinal") % 5).join(quotes, ["page", "quote_ordinal"], "left").select("page", "ordinal", "quote")


@query(
    "parent_climb",
    """
    WITH RECURSIVE n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 OR c_custkey < 2 THEN NULL ELSE c_custkey // 2 END AS p FROM customer),
    c AS (SELECT k, k AS top, 0 AS steps FROM n UNION ALL SELECT c.k, n.p, c.steps + 1 FROM c JOIN n ON n.k = c.top WHERE n.p IS NOT NULL AND n.p IN (SELECT k FROM n) AND c.steps < 8)
    SELECT k AS node, arg_max(top, steps) AS top, max(steps) AS steps FROM c GROUP BY k
    """,
)
def parent_climb(spark, d):  # noqa: ANN001, ANN201
    parent = F.when((F.col("c_custkey") % 7 == 0) | (F.col("c_custkey") < 2), F.lit(None)).otherwise(F.floor(F.col("c_custkey") / 2))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), parent.cast("long").alias("parent"))
    known = nodes.select(F.col("node").alias("parent"))
    rooted = nodes.join(known.withColumn("there", F.lit(True)), "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    return ops.climb(rooted, "node", "parent", 8).select("node", "top", F.col("steps").cast("int").alias("steps"))


@query(
    "ancestor_overlap",
    """
    WITH RECURSIVE n AS (SELECT c_custkey AS k, CASE WHEN c_custkey >= 2 THEN c_custkey // 2 END AS p, c_nationkey AS question FROM customer),
    c AS (SELECT k, p AS a FROM n WHERE p IN (SELECT k FROM n) UNION ALL SELECT c.k, n.p FROM c JOIN n ON n.k = c.a WHERE n.p IN (SELECT k FROM n)),
    h AS (SELECT question, k FROM n), b AS (SELECT h.question, c.k, c.a FROM h JOIN c ON c.k = h.k JOIN h g ON g.question = h.question AND g.k = c.a)
    SELECT h.question, count(DISTINCT h.k) AS hits, count(DISTINCT b.k) AS covered, count(DISTINCT b.a) AS covering FROM h LEFT JOIN b ON b.question = h.question GROUP BY 1
    """,
)
def ancestor_overlap(spark, d):  # noqa: ANN001, ANN201
    """Of each nation's customers those below another of the nation, in the tree of halved numbers."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") >= 2, F.floor(F.col("c_custkey") / 2)).alias("parent"), F.col("c_nationkey").alias("question"))
    known = rows.join(rows.select(F.col("node").alias("parent")), "parent", "left_semi")
    return ops.ancestor_overlap(rows.select("question", "node"), ops.ancestors(known, "node", "parent"))


@query("sibling_join", "SELECT a.n_nationkey, b.n_nationkey AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def sibling_join(spark, d):  # noqa: ANN001, ANN201
    return ops.siblings(table(spark, d, "nation"), ["n_regionkey"], "n_nationkey").select("n_nationkey", "sibling")


@query(
    "dictionary_longest_match",
    """
    WITH names AS (SELECT unnest(['the', 'and', 'of the', 'in the', 'and the the']) AS name),
    h AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS k
        FROM documents JOIN names ON contains(' ' || regexp_replace(lower(text), '[\\t-\\r ]+', ' ', 'g') || ' ', ' ' || name || ' '))
    SELECT doc_id, name FROM h WHERE k = 1
    """,
)
def dictionary_longest_match(spark, d):  # noqa: ANN001, ANN201
    names = spark.createDataFrame([(n,) for n in ("the", "and", "of the", "in the", "and the the")], "name string")
    return ops.longest_match(table(spark, d, "documents"), "doc_id", "text", names, "name").select("doc_id", "name")


@query("prefix_probe_join", "WITH s AS (SELECT DISTINCT source FROM documents), p AS (SELECT source || ':probe' AS probe, doc_id FROM documents) SELECT s.source, bool_or(p.doc_id % 50 = 0) AS any_ok, count(*) AS probes FROM s JOIN p ON starts_with(p.probe, s.source || ':') GROUP BY 1")
def prefix_probe_join(spark, d):  # noqa: ANN001, ANN201
    # The prefix ends at a fixed sign, so the join is by equality of what stands before it.
    p = table(spark, d, "documents").select(F.concat("source", F.lit(":probe")).alias("probe"), "doc_id")
    p = p.withColumn("source", F.substring_index("probe", ":", 1))
    known = table(spark, d, "documents").select("source").distinct()
    return p.join(known, "source").groupBy("source").agg(F.bool_or(F.col("doc_id") % 50 == 0).alias("any_ok"), F.count(F.lit(1)).alias("probes"))


@query("top_k_nulls_last", f"WITH {FACTS_SQL} SELECT o_orderkey, valid_to FROM f ORDER BY valid_to DESC NULLS LAST, o_orderkey LIMIT 20")
def top_k_nulls_last(spark, d):  # noqa: ANN001, ANN201
    return orders_as_facts(spark, d).select("o_orderkey", "valid_to").orderBy(F.desc_nulls_last("valid_to"), "o_orderkey").limit(20)


@query("case_ordered_top", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 25")
def case_ordered_top(spark, d):  # noqa: ANN001, ANN201
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(rank, "o_orderkey").select("o_orderkey", "o_orderstatus").limit(25)


@query("upcoming_first", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY CASE WHEN o_orderdate::DATE >= DATE '1998-06-01' THEN 0 ELSE 1 END, abs(o_orderdate::DATE - DATE '1998-06-01'), o_orderkey LIMIT 30")
def upcoming_first(spark, d):  # noqa: ANN001, ANN201
    day = F.to_date("o_orderdate")
    today = F.lit(DAY).cast("date")
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("day"))
    return rows.orderBy(F.when(F.col("day") >= today, 0).otherwise(1), F.abs(F.datediff("day", today)), "o_orderkey").limit(30)


@query("filter_sort_cut", "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 300) ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def filter_sort_cut(spark, d):  # noqa: ANN001, ANN201
    pool = table(spark, d, "orders").where("o_orderstatus <> 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(300)
    return pool.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("observation_days", "SELECT DISTINCT user_id AS facility, ts::DATE AS valid_from FROM events")
def observation_days(spark, d):  # noqa: ANN001, ANN201
    return hours(spark, d).select("facility", "valid_from").distinct()


@query("overview_fan_out", "SELECT s_suppkey, day::DATE AS day, coalesce(n, 0) AS shipments FROM supplier CROSS JOIN generate_series(DATE '1997-01-01', DATE '1997-01-03', INTERVAL 1 DAY) g(day) LEFT JOIN (SELECT l_suppkey, l_shipdate::DATE AS dd, count(*) AS n FROM lineitem GROUP BY 1, 2) x ON x.l_suppkey = s_suppkey AND x.dd = day::DATE")
def overview_fan_out(spark, d):  # noqa: ANN001, ANN201
    days = F.explode(F.sequence(F.lit("1997-01-01").cast("date"), F.lit("1997-01-03").cast("date")))
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    wanted = table(spark, d, "supplier").select("s_suppkey", days.alias("day"))
    return wanted.join(shipped, ["s_suppkey", "day"], "left").select("s_suppkey", "day", F.coalesce("n", F.lit(0)).cast("long").alias("shipments"))
