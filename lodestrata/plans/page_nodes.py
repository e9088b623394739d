"""Queries on node tables: pages assembled from orders for two profiles and none, and the pages table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.plans._registry import query
from lodestrata.plans.markup import _joined
from lodestrata.session import stored, table
from lodestrata.sources import links, nodes

PROFILES = [nodes.Profile("central", ("#wrap .inner", "#wrap"), (".box",), ("nav", ".board")), nodes.Profile("builder", ("#builder",), (".obj",), (".hidden",))]
GENERIC = nodes.Profile("generic", (), (), ("script", "style", "nav", "header", "footer", ".menu"))


def _pages(spark, d):  # noqa: ANN001, ANN202
    """A page per customer with orders: its segment decides how it is built.  page, host and html."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "central").when(F.col("c_mktsegment") == "MACHINERY", "builder").otherwise("generic")
    no = F.concat(F.lit("order "), "o_orderkey")
    row = (
        F.when(kind == "central", F.concat(F.lit("<div class='box wide'>"), no, F.lit("<div class=box> is "), "o_orderstatus", F.lit("</div><ul class=board><li>list</ul></div>")))
        .when(kind == "builder", F.concat(F.lit("<div class=obj>"), no, F.lit("<span class=hidden>fn=1</span></div>")))
        .otherwise(F.concat(F.lit("<p>"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<b>"), no, F.lit("</b>"))).otherwise(no), F.lit(" was placed</p>")))
    )
    # The segment is a customer's, so it can be a key beside the customer's own.
    made = _joined(orders.withColumn("kind", kind), ["o_custkey", "c_mktsegment", "kind"], "o_orderkey", row, "", "")
    before = F.when(F.col("kind") == "central", "<body><nav>menu</nav><div id=wrap><div class=inner>").when(F.col("kind") == "builder", "<body><div id=builder>").otherwise("<body><nav>menu</nav><div><a href=/>all orders</a></div><div id=text>")
    after = F.when(F.col("kind") == "central", "</div></div></body>").otherwise("</div></body>")
    return made.select(F.col("o_custkey").alias("page"), F.lower("c_mktsegment").alias("host"), F.concat(before, "html", after).alias("html"))


ORDERS_SQL = """
o AS (
    SELECT o_custkey AS page, o_orderkey AS k, o_orderstatus AS s, lower(c_mktsegment) AS host,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'central' WHEN 'MACHINERY' THEN 'builder' ELSE 'generic' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey
)"""


@query(
    "page_blocks",
    f"""
    WITH {ORDERS_SQL}, g AS (SELECT page, host, string_agg('order ' || k || ' was placed', ' ' ORDER BY k) AS text, sum(length('order' || k || 'wasplaced')) AS x FROM o WHERE kind = 'generic' GROUP BY 1, 2)
    SELECT page, kind AS profile, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS block, 'order ' || k || CASE WHEN kind = 'central' THEN ' is ' || s ELSE '' END AS text FROM o WHERE kind <> 'generic'
    UNION ALL SELECT page, 'generic:' || host, 0, CASE WHEN x >= 120 AND x <= 0.99 * (x + 9) THEN text ELSE 'all orders ' || text END FROM g WHERE x + 9 >= 120
    """,
)
def page_blocks(spark, d):  # noqa: ANN001, ANN201
    pages = stored(_pages(spark, d), "pages")
    return nodes.blocks(stored(nodes.nodes(pages, "page"), "nodes"), pages.select("page", "host"), PROFILES, GENERIC)


@query(
    "page_profiles",
    f"WITH {ORDERS_SQL} SELECT CASE kind WHEN 'generic' THEN 'generic:' || host ELSE kind END AS profile, count(DISTINCT page) AS pages FROM o GROUP BY 1",
)
def page_profiles(spark, d):  # noqa: ANN001, ANN201
    """How many pages there are of each profile; those without a container count by host."""
    pages = stored(_pages(spark, d), "pages")
    held = stored(nodes.nodes(pages, "page", holding=nodes.container_tokens(PROFILES)), "nodes")
    found = pages.select("page", "host").join(nodes.containers(held, PROFILES).select("page", "profile"), "page", "left")
    return found.groupBy(F.coalesce("profile", F.concat_ws(":", F.lit("generic"), "host")).alias("profile")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "page_shapes",
    f"""
    WITH {ORDERS_SQL}, r AS (SELECT *, CASE WHEN kind <> 'generic' THEN 'x' WHEN s = 'F' THEN 'b' ELSE 'p' END AS c, lag(CASE WHEN kind <> 'generic' THEN 'x' WHEN s = 'F' THEN 'b' ELSE 'p' END) OVER (PARTITION BY page ORDER BY k) AS before FROM o),
    p AS (SELECT page, host, kind, string_agg(c, '' ORDER BY k) FILTER (WHERE before IS DISTINCT FROM c) AS shape FROM r GROUP BY ALL),
    h AS (SELECT kind, shape, host, count(*) AS n FROM p GROUP BY ALL)
    SELECT sum(n)::BIGINT AS pages, count(*) AS hosts, list(host ORDER BY n DESC, host DESC)[1] AS main_host FROM h GROUP BY kind, shape
    """,
)
def page_shapes(spark, d):  # noqa: ANN001, ANN201
    """Pages by the shape of their body."""
    pages = stored(_pages(spark, d), "pages")
    return nodes.census(nodes.page_fingerprints(pages, "page"), pages.select("page", "host")).select("pages", "hosts", "main_host")


@query("shape_census")
def shape_census(spark, d):  # noqa: ANN001, ANN201
    """The pages table by the shape of its pages' bodies."""
    pages = table(spark, d, "pages")
    hosts = pages.select(F.col("page_id").alias("page"), links.host_of(F.col("url")).alias("host"))
    return nodes.census(nodes.page_fingerprints(pages), hosts)
