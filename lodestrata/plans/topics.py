"""Queries on lookups by topic, and the two-pass build of a page corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import corpus, topics
from lodestrata.plans._registry import query
from lodestrata.plans._tables import page_sections
from lodestrata.session import table
from lodestrata.sources import html, links

DAY = "1998-06-01"


@query("topic_lookup", "SELECT doc_id, CASE WHEN contains(regexp_replace(text, '\\s+', '', 'g'), 'Licensedunder') THEN 'license' WHEN contains(regexp_replace(text, '\\s+', '', 'g'), 'Apache') THEN 'apache' END AS topic FROM documents")
def topic_lookup(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", topics.topic_of(F.col("text"), {"Apache": "apache", "Licensed under": "license"}).alias("topic"))


@query("calendar_topic_search", f"SELECT o_orderkey, o_orderpriority AS title FROM (SELECT *, o_orderdate::DATE AS s, CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE + 30 END AS e FROM orders) WHERE contains(regexp_replace(o_orderpriority, '\\s+', '', 'g'), 'URGENT') ORDER BY coalesce(e, s) < DATE '{DAY}', abs(s - DATE '{DAY}') * CASE WHEN coalesce(e, s) < DATE '{DAY}' OR s >= DATE '{DAY}' THEN 1 ELSE -1 END, o_orderkey LIMIT 20")
def calendar_topic_search(spark, d):  # noqa: ANN001, ANN201
    s = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), s.alias("start_date"), F.when(F.col("o_orderstatus") == "O", F.date_add(s, 30)).alias("end_date"))
    found = topics.entries_on(rows, ["UR GENT"], F.lit(DAY).cast("date"))
    return found.orderBy("past", "away", "o_orderkey").select("o_orderkey", "title").limit(20)


@query("open_posts", f"SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high')) AND (o_orderstatus <> 'O' OR o_orderdate::DATE + 90 >= DATE '{DAY}') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def open_posts(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders")
    posts = o.select(F.col("o_orderkey").alias("post_key"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"), F.when(F.col("o_orderstatus") == "O", F.date_add(F.to_date("o_orderdate"), 90)).alias("deadline"))
    return topics.posts_on(posts, ["HIGH"], F.lit(DAY).cast("date")).select(F.col("post_key").alias("o_orderkey"))


@query("recruiting_census", f"SELECT CASE WHEN k > 1 THEN 'same_title' WHEN make_date(year(o_orderdate), 3, 1) < DATE '{DAY}' THEN CASE WHEN o_orderdate::DATE - make_date(year(o_orderdate), 3, 1) > 180 AND make_date(year(o_orderdate) + 1, 3, 1) >= DATE '{DAY}' THEN 'shown' ELSE 'past' END ELSE 'shown' END AS state, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1")
def recruiting_census(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(" camp (~3/1)")).alias("title"), F.to_date("o_orderdate").alias("published_at"))
    found = topics.recruiting(o, F.lit(DAY).cast("date"), [F.col("o_orderkey")])
    return found.groupBy(F.coalesce("dropped", F.lit("shown")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("exact_title_block", "WITH l AS (SELECT doc_id AS page, unnest(range(len(string_split(text, chr(10)))))::INT AS ordinal, unnest(string_split(text, chr(10))) AS title FROM documents) SELECT page, min(ordinal) AS ordinal FROM l WHERE lower(regexp_replace(title, '[\\s[:punct:]]+', '', 'g')) = 'andornd' GROUP BY 1")
def exact_title_block(spark, d):  # noqa: ANN001, ANN201
    blocks = page_sections(spark, d).select("page", "ordinal", F.col("text").alias("title"))
    return topics.exact_block(blocks, "and, ornd!").select("page", "ordinal")


@query("chosen_options", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery' END AS chosen, c_mktsegment IN ('BUILDING', 'MACHINERY') AS narrowed FROM customer")
def chosen_options(spark, d):  # noqa: ANN001, ANN201
    options = F.array(F.lit("Building"), F.lit("Machinery"))
    return table(spark, d, "customer").select("c_custkey", topics.chosen(options, F.col("c_mktsegment")).alias("chosen"), topics.narrowed(options, F.col("c_mktsegment")).alias("narrowed"))


@query("page_corpus_build")
def page_corpus_build(spark, d):  # noqa: ANN001, ANN201
    """Pages in two passes: fragments of all pages tell boilerplate by profile (the host), then the
    fragments of each page without it."""
    pages = table(spark, d, "pages")
    hosts = pages.select("page_id", links.host_of(F.col("url")).alias("host"))
    found = html.rows_of(pages, html.fragments, "text string").join(hosts, "page_id")
    made = corpus.fragments(found, "host", "page_id", "text")
    kept = corpus.prune(made, corpus.boilerplate(made))
    return kept.groupBy("page").agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.char_length("text")).alias("chars"), F.bool_or("held").alias("held"))
