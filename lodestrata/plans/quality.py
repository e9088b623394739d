"""Queries on reconciliation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import reconcile, validate
from lodestrata.plans._registry import query
from lodestrata.plans._tables import SECTIONS_SQL, page_sections
from lodestrata.session import table

TWO_SOURCES = """
p AS (SELECT l_orderkey AS k, array_to_string(list_sort(list(l_partkey)), ',') AS i, bool_or(l_returnflag <> 'N') AS o FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
s AS (SELECT l_orderkey AS k, array_to_string(list_sort(list(l_partkey)), ',') AS i, bool_or(l_returnflag <> 'N') AS o FROM lineitem WHERE l_linenumber % 3 = 1 GROUP BY 1),
c AS (SELECT k, p.i AS pi, s.i AS si, CASE WHEN NOT coalesce(p.o, false) AND NOT coalesce(s.o, false) THEN 'silent' WHEN NOT coalesce(s.o, false) THEN 'primary_only'
    WHEN NOT coalesce(p.o, false) THEN 'secondary_only' WHEN p.i IS NOT DISTINCT FROM s.i THEN 'match' ELSE 'conflict' END AS result FROM p FULL JOIN s USING (k))"""


def compared(spark, d):  # noqa: ANN001, ANN201
    items = table(spark, d, "lineitem")
    side = lambda keep: items.where(keep).groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_partkey")).alias("items"), F.bool_or(F.col("l_returnflag") != "N").alias("observed"))
    return reconcile.compare(side("l_linenumber % 2 = 1"), side("l_linenumber % 3 = 1"), ["k"], "items", "observed")


@query("reconcile_compare", f"WITH {TWO_SOURCES} SELECT k, pi AS primary_items, si AS secondary_items, result FROM c")
def reconcile_compare(spark, d):  # noqa: ANN001, ANN201
    return compared(spark, d).select("k", F.array_join("primary_items", ",").alias("primary_items"), F.array_join("secondary_items", ",").alias("secondary_items"), "result")


@query("reconcile_merge", f"WITH {TWO_SOURCES} SELECT k, CASE WHEN result = 'secondary_only' THEN si ELSE coalesce(pi, si) END AS items, CASE WHEN result = 'secondary_only' OR pi IS NULL THEN 'secondary' ELSE 'primary' END AS origin, result = 'conflict' AS conflict FROM c")
def reconcile_merge(spark, d):  # noqa: ANN001, ANN201
    return reconcile.merge(compared(spark, d), ["k"]).withColumn("items", F.array_join("items", ","))


@query("reconcile_rates", f"WITH {TWO_SOURCES} SELECT round(count(*) FILTER (WHERE result = 'conflict') / count(*) FILTER (WHERE result IN ('match', 'conflict')), 6) AS conflict_rate, round(count(*) FILTER (WHERE result IN ('primary_only', 'secondary_only')) / count(*) FILTER (WHERE result <> 'silent'), 6) AS gap_rate FROM c")
def reconcile_rates(spark, d):  # noqa: ANN001, ANN201
    return reconcile.rates(compared(spark, d))


@query("conflict_notes", f"WITH {TWO_SOURCES} SELECT k, CASE WHEN result = 'conflict' THEN 'checked | differs' ELSE 'checked' END AS note FROM c")
def conflict_notes(spark, d):  # noqa: ANN001, ANN201
    return compared(spark, d).select("k", reconcile.noted(F.lit("checked"), F.col("result") == "conflict", F.lit("differs")).alias("note"))


@query(
    "first_failure_reason",
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'quantity' WHEN NOT l_discount <= 0.09 THEN 'discount'
        WHEN NOT (l_returnflag <> 'R' OR l_tax < 0.05) THEN 'tax' ELSE 'passed' END AS reason FROM lineitem
    """,
)
def first_failure_reason(spark, d):  # noqa: ANN001, ANN201
    rules = [("quantity", F.col("l_quantity").between(1, 45)), ("discount", F.col("l_discount") <= 0.09), ("tax", (F.col("l_returnflag") != "R") | (F.col("l_tax") < 0.05))]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(validate.first_failure(rules), F.lit("passed")).alias("reason"))


@query("quarantine_split", "SELECT 'good' AS side, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 300000 UNION ALL SELECT 'set_apart', count(*) FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 300000")
def quarantine_split(spark, d):  # noqa: ANN001, ANN201
    good, bad = validate.split_by(table(spark, d, "orders"), validate.first_failure([("price", F.col("o_totalprice").between(1000, 300000))]))
    one = lambda rows, side: rows.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return one(good, "good").unionByName(one(bad, "set_apart"))


@query("price_rules", "SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'no_text' WHEN NOT p_retailprice BETWEEN 500 AND 20000 THEN 'range' WHEN p_size % 4 <> 0 AND p_size * 30.0 < p_retailprice THEN 'order' WHEN p_size % 4 <> 0 AND NOT p_size * 30.0 BETWEEN 500 AND 20000 THEN 'range_max' END AS reason FROM part")
def price_rules(spark, d):  # noqa: ANN001, ANN201
    part = table(spark, d, "part").withColumn("most", F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 30.0))
    return part.select("p_partkey", validate.first_failure(validate.price_rules(F.col("p_name"), "p_retailprice", "most")).alias("reason"))


@query("term_misalignment", "SELECT o_custkey, round(avg((NOT month(o_orderdate) BETWEEN 3 AND 8)::INT), 6) AS off_share, avg((NOT month(o_orderdate) BETWEEN 3 AND 8)::INT) > 0.5 AS misaligned FROM orders GROUP BY 1")
def term_misalignment(spark, d):  # noqa: ANN001, ANN201
    return validate.mostly_outside(table(spark, d, "orders"), "o_custkey", "o_orderdate", 3, 8)


@query("cell_crosscheck", "WITH a AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x, list(l_partkey ORDER BY l_partkey) AS y FROM lineitem GROUP BY 1) SELECT k, x = y AS same FROM a")
def cell_crosscheck(spark, d):  # noqa: ANN001, ANN201
    both = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"), F.sort_array(F.collect_list("l_partkey")).alias("y"))
    return both.select("k", validate.same_items(F.transform("x", lambda e: e["l_partkey"]), F.col("y"), lambda e: e.cast("string")).alias("same"))


@query("ragged_tables", "WITH x AS (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda r: trim(r) <> '') AS rows FROM documents WHERE contains(text, '|')) SELECT lang, count(*) AS tables, count(*) FILTER (WHERE len(list_distinct(list_transform(rows, lambda r: len(string_split(r, '|'))))) > 1) AS ragged FROM x GROUP BY 1")
def ragged_tables(spark, d):  # noqa: ANN001, ANN201
    from lodestrata.functions.predicates import ragged

    rows = table(spark, d, "documents").where(F.contains("text", F.lit("|")))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("tables"), F.count_if(ragged(F.col("text"))).alias("ragged"))


@query(
    "self_contained_flag",
    f"""
    WITH {SECTIONS_SQL}, t AS (SELECT page, ordinal, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM sec)
    SELECT page, ordinal, CASE WHEN t = '' OR regexp_matches(t, '^[\\d\\s.,\\-~/()%]+$') OR t = 'All' THEN false
        WHEN regexp_matches(t, '[^\\s:|][^\\n]*[:|]\\s*\\S') THEN true ELSE length(t) >= 12 AND len(string_split(t, ' ')) >= 3 END AS whole FROM t
    """,
)
def self_contained_flag(spark, d):  # noqa: ANN001, ANN201
    from lodestrata.functions.predicates import self_contained

    return page_sections(spark, d).select("page", "ordinal", self_contained(F.col("text")).alias("whole"))


@query("empty_page_split", "SELECT page_id, CASE WHEN NOT regexp_matches(html, '<p>[^<]') THEN CASE WHEN contains(html, '<form') THEN 'empty_nocontent' ELSE 'empty_unparsed' END ELSE 'ok' END AS state FROM pages")
def empty_page_split(spark, d):  # noqa: ANN001, ANN201
    state = F.when(~F.regexp_like("html", F.lit("<p>[^<]")), F.when(F.contains("html", F.lit("<form")), "empty_nocontent").otherwise("empty_unparsed")).otherwise("ok")
    return table(spark, d, "pages").select("page_id", state.alias("state"))


@query("provenance_check", "SELECT o_orderkey, o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND (o_orderstatus <> 'P' OR o_orderdate < TIMESTAMP '2000-01-01') AS ok FROM orders")
def provenance_check(spark, d):  # noqa: ANN001, ANN201
    from lodestrata.operators.facts import provenance_ok

    o = table(spark, d, "orders")
    named = o.select(
        "o_orderkey", F.col("o_custkey").alias("source_id"), F.col("o_totalprice").alias("source_url"), F.col("o_orderdate").alias("observed_at"),
        F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("valid_to"),
        F.lit(0.9).alias("confidence"), F.lit("table").alias("extraction_method"), F.lit("verified").alias("status"),
        F.when(F.col("o_orderstatus") == "P", "T4").otherwise("T1").alias("tier"),
    )
    return named.select("o_orderkey", provenance_ok().alias("ok"))
