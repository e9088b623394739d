"""Queries on sources: pages as rows, links, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators.ranking import numbered
from lodestrata.plans._registry import query
from lodestrata.session import table
from lodestrata.sources import files, html, links


@query("html_leaves", "SELECT page_id, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages")
def html_leaves(spark, d):  # noqa: ANN001, ANN201
    """Pages and their headings, read through the section reader's tree."""
    found = html.rows_of(table(spark, d, "pages"), lambda h: [{"headings": len(html.parse(h).find("h1"))}], "headings long")
    return found


@query("html_sections")
def html_sections(spark, d):  # noqa: ANN001, ANN201
    """Sections of every page: quotes and leaves."""
    return html.rows_of(table(spark, d, "pages"), html.sections, "ordinal int, kind string, path string, text string, is_leaf boolean, parent double, depth int")


@query("html_fragments")
def html_fragments(spark, d):  # noqa: ANN001, ANN201
    return html.rows_of(table(spark, d, "pages"), html.fragments, "text string")


@query("html_density")
def html_density(spark, d):  # noqa: ANN001, ANN201
    """The container of each page's densest text, and how long that is."""
    return html.rows_of(table(spark, d, "pages"), lambda h: [{"container": (n := html.density_root(h)).tag, "chars": len(n.text())}], "container string, chars long")


@query("link_extract", "SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1, 'i')) AS href FROM pages")
def link_extract(spark, d):  # noqa: ANN001, ANN201
    return links.extract(table(spark, d, "pages")).distinct()


@query("url_classify", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)lists?\\.do') THEN 'board_list' WHEN regexp_matches(url, '(?i)\\.do(\\?|$)') THEN 'static_page' ELSE 'other' END AS kind, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages")
def url_classify(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", links.classify(F.col("url")).alias("kind"), links.host_of(F.col("url")).alias("host"))


@query("url_normalize", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/?#:]+\\.)?example\\.com([/?#:]|$)') AND NOT regexp_matches(url, '(?i)\\.(pdf|zip|png)(\\?|$)') AND NOT regexp_matches(regexp_replace(url, '^https?://[^/]+', ''), '(?i)(logout|login|download|delete|update|write|print|excel)') THEN string_split(url, '#')[1] END AS normal FROM pages")
def url_normalize(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", links.normalize(F.col("url"), F.col("url"), "example.com").alias("normal"))


@query("crawl_targets", "WITH x AS (SELECT DISTINCT url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE contains(url, '.org/'))) SELECT url, host, row_number() OVER (PARTITION BY host ORDER BY url) AS turn, min(url) OVER (PARTITION BY host) AS seen FROM x")
def crawl_targets(spark, d):  # noqa: ANN001, ANN201
    pages = table(spark, d, "pages")
    found = links.targets(pages, "url", pages.where(F.contains("url", F.lit(".org/"))))
    return found.select("url", "host", F.col("turn").cast("long").alias("turn"), "seen")


@query(
    "menu_order",
    """
    WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1, 'i') AS l FROM pages),
    h AS (SELECT host, page_id, unnest(l) AS href, unnest(range(len(l))) AS pos FROM p),
    f AS (SELECT host, href, min({'p': page_id, 'k': pos}) AS first FROM h WHERE href <> '' AND host <> '' GROUP BY 1, 2)
    SELECT host, href, row_number() OVER (PARTITION BY host ORDER BY first) AS place FROM f
    """,
)
def menu_order(spark, d):  # noqa: ANN001, ANN201
    return links.menu_order(table(spark, d, "pages"))


@query("item_places", "SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem")
def item_places(spark, d):  # noqa: ANN001, ANN201
    """Row numbers within three groups, of which one holds half of all rows."""
    order = [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return numbered(table(spark, d, "lineitem"), ["l_returnflag"], order).select("l_returnflag", "l_orderkey", "l_linenumber", "place")


@query("link_reach", "WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem), r(url, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT l.target, r.depth + 1 FROM r JOIN l ON l.source = r.url WHERE r.depth < 3) SELECT url, min(depth)::INT AS depth FROM r GROUP BY 1")
def link_reach(spark, d):  # noqa: ANN001, ANN201
    # An order leads to its parts, and a part's number to the order of that number.
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return links.reach(edges, spark.range(7, 8).select(F.col("id").alias("url")), 3)


@query("variant_fan_out", "SELECT DISTINCT o_custkey, (year(o_orderdate) + y)::INT AS ac_year, s AS ac_semester FROM orders, range(-2, 2) r(y), (SELECT unnest([1, 2]) AS s)")
def variant_fan_out(spark, d):  # noqa: ANN001, ANN201
    """Of each customer the years around those of its orders, with both semesters."""
    seen = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    return files.variants(seen, "year", 2, 1, [1, 2])


@query("push_guard", "SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20 00:06:00' THEN 'future' WHEN ts < TIMESTAMP '2024-01-18' THEN 'too_old' END AS reason FROM events")
def push_guard(spark, d):  # noqa: ANN001, ANN201
    payloads = table(spark, d, "events").select("event_id", F.base64(F.encode("props", "UTF-8")).alias("content"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return files.accepted(payloads, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id", "reason")
