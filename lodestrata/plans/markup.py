"""Queries on markup: pages are assembled from tables, read back, and held against those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.plans._registry import query
from lodestrata.session import table
from lodestrata.sources import dining, html, week_table


def _joined(rows: DataFrame, key: str | list[str], order: str, row, before: str = "<table>", after: str = "</table>") -> DataFrame:  # noqa: ANN001
    """A page (key, html) per key: the markup of its rows in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("row"))))
    page = F.concat(F.lit(before), F.array_join(F.transform(parts, lambda x: x["row"]), ""), F.lit(after))
    return rows.groupBy(*([key] if isinstance(key, str) else key)).agg(page.alias("html"))


def _boards(spark, d):  # noqa: ANN001, ANN202
    """A notice board per customer: an order a row, some linked by address, some by a call."""
    shown = F.concat(F.lit("order no "), "o_orderkey")
    by_call = F.concat(F.lit("<a href='#' onclick='view("), "o_orderkey", F.lit(")'>"), shown, F.lit("</a>"))
    by_link = F.concat(F.lit("<a href='/o/"), "o_orderkey", F.lit("'>"), shown, F.lit("</a><a href='/x'>x</a>"))
    row = F.concat(F.lit("<tr><td>"), F.when(F.col("o_orderstatus") == "F", by_call).otherwise(by_link), F.lit("<td>"), F.date_format("o_orderdate", "yyyy.M.d"), F.lit("</tr>"))
    return _joined(table(spark, d, "orders"), "o_custkey", "o_orderkey", row)


@query("html_board_rows", "SELECT o_custkey, 'order no ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'F' THEN '' ELSE '/o/' END || o_orderkey AS link, strftime(o_orderdate::DATE, '%Y-%m-%d') AS published_at FROM orders")
def html_board_rows(spark, d):  # noqa: ANN001, ANN201
    return html.rows_of(_boards(spark, d), html.board, "title string, link string, published_at string", "o_custkey")


@query("html_boards", "SELECT o_custkey, count(*) >= 3 AS board FROM orders GROUP BY 1")
def html_boards(spark, d):  # noqa: ANN001, ANN201
    """Which pages are boards: those with three rows at least."""
    return html.rows_of(_boards(spark, d), lambda h: [{"board": html.is_board(h)}], "board boolean", "o_custkey")


@query(
    "html_table_rows",
    """
    WITH l AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, 'Lines: order: no ' || l_orderkey || ' | line: ' || l_linenumber || ' | part: ' || l_partkey || ' | amount: ' || l_quantity::INT AS text FROM l
    """,
)
def html_table_rows(spark, d):  # noqa: ANN001, ANN201
    """Leaves of tables whose first cell hangs over all rows."""
    lines = table(spark, d, "lineitem")
    cells = F.concat(F.lit("<td>"), "l_linenumber", F.lit("</td><td>"), "l_partkey", F.lit("<td>"), F.col("l_quantity").cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", cells.alias("row"))))
    pages = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.transform(parts, lambda x: x["row"]).alias("rows"))
    head = F.concat(F.lit("<h2>Lines</h2><table><tr><th>order<th>line<th>part<th>amount</tr><tr><td rowspan="), "n", F.lit(">no "), "l_orderkey", F.lit("</td>"))
    pages = pages.select("l_orderkey", F.concat(head, F.array_join("rows", "</tr><tr>"), F.lit("</tr></table>")).alias("html"))
    found = html.rows_of(pages, html.sections, "ordinal int, kind string, path string, text string, is_leaf boolean, parent double, depth int", "l_orderkey")
    return found.where("kind = 'table_row'").select("l_orderkey", "text")


@query("html_definitions", "SELECT n_regionkey, n_nationkey::VARCHAR AS \"when\", n_name AS title, '' AS error FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 2, '', '', 'unpaired'")
def html_definitions(spark, d):  # noqa: ANN001, ANN201
    """Terms with their definitions; the list of a region that lacks a definition is an error."""
    nation = table(spark, d, "nation")
    row = F.concat(F.lit("<dt>"), "n_nationkey", F.when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") == 7), "").otherwise(F.concat(F.lit("<dd>"), "n_name")))
    return html.rows_of(_joined(nation, "n_regionkey", "n_nationkey", row, "<dl>", "</dl>"), html.calendar, "when string, title string, error string", "n_regionkey")


def _dining(spark, d):  # noqa: ANN001, ANN202
    """A dining page per nation."""
    page = F.format_string(
        "<p class='title'>%s</p><table><tr><td>점심<td>평일 11:%02d ~ 14:00<td>%s</tr></table>"
        "<table><tr><th>구분<th>코너<th>월요일 2026-03-02<th>화요일 2026-03-03</tr><tr><td rowspan=2>중식<td>A<td data-date=2026-03-02>rice<br>%s/soup<td>%s</tr>"
        "<tr><td>B<td colspan=2>curry</tr></table><p class='title'>prices</p><table><tr><th>메뉴<th>단가</tr><tr><td>%s<td>%d,500원 부터</tr></table>",
        "n_name", F.col("n_nationkey") * 2, F.when(F.col("n_nationkey") % 2 == 0, "주말 미운영").otherwise(""), "n_name",
        F.when(F.col("n_nationkey") % 3 == 0, "미운영").otherwise(""), "n_name", F.col("n_nationkey") + 1,
    )
    return dining.cells(table(spark, d, "nation").select("n_nationkey", page.alias("html")), "n_nationkey")


@query(
    "dining_hours",
    """
    SELECT n_nationkey, n_name AS place, 'lunch' AS meal, w::INT AS weekday, '11:' || lpad((n_nationkey * 2)::VARCHAR, 2, '0') AS open, '14:00' AS close, false AS closed FROM nation, range(1, 6) r(w)
    UNION ALL SELECT n_nationkey, n_name, 'lunch', w, NULL, NULL, true FROM nation, (SELECT unnest([0, 6]) AS w) WHERE n_nationkey % 2 = 0
    """,
)
def dining_hours(spark, d):  # noqa: ANN001, ANN201
    return dining.hours(_dining(spark, d), "n_nationkey")


@query(
    "dining_menus",
    """
    SELECT n_nationkey, n_name AS place, DATE '2026-03-02' + c::INT AS date, c::INT + 1 AS weekday, 'lunch' AS meal, k AS corner,
        CASE WHEN k = 'B' OR c = 0 THEN 'operating' WHEN n_nationkey % 3 = 0 THEN 'closed_temporary' ELSE 'unknown' END AS status,
        CASE WHEN k = 'B' THEN 'curry' WHEN c = 0 THEN 'rice,' || n_name || ',soup' ELSE '' END AS items
    FROM nation, range(0, 2) r(c), (SELECT unnest(['A', 'B']) AS k)
    """,
)
def dining_menus(spark, d):  # noqa: ANN001, ANN201
    return dining.menus(_dining(spark, d), "n_nationkey").drop("aligned").withColumn("items", F.array_join("items", ","))


@query("dining_prices", "SELECT n_nationkey, 'prices' AS place, n_name AS name, '전체' AS audience, (n_nationkey + 1) || ',500원 부터' AS price_text, (n_nationkey + 1)::INT * 1000 + 500 AS price_min, NULL::INT AS price_max FROM nation")
def dining_prices(spark, d):  # noqa: ANN001, ANN201
    return dining.prices(_dining(spark, d), "n_nationkey")


def _week_pages(spark, d):  # noqa: ANN001, ANN202
    """A week of meals per customer; some pages contradict themselves."""
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2026-01-04").cast("date"), (k % 50 * 7).cast("int"))
    header = [F.date_add(start, F.when(k % 13 == 0, i + 1).otherwise(i)) for i in range(7)]
    heads = [F.concat(F.lit(f"<th>{day}요일\n ("), F.date_format(on, "dd"), F.lit(")</th>")) for day, on in zip(week_table.DAYS, header, strict=True)]
    linked = lambda body, title: F.concat(F.lit("<td><a class='calendar_pop' title='"), title, F.lit("'>"), body, F.lit("</a></td>"))
    name = F.col("c_name")
    cells = [
        linked(F.concat(F.lit("white\nrice<br>"), name), F.concat(F.lit("white rice, "), name)), linked(F.lit("[holiday]"), F.lit("")), linked(F.lit("식사없음"), F.lit("")), F.lit("<td></td>"),
        linked(F.concat(F.lit("soup<br>"), name), F.lit("soup")), linked(name, name), F.when(k % 17 == 0, "").otherwise("<td>closed?</td>"),
    ]
    beside = lambda days, side: F.concat(F.lit('<a href="in.php?m=1&amp;date='), F.date_format(F.date_add(start, days), "yyyy-MM-dd"), F.lit(f'" class=w><img src="{side}_btn.gif"></a>'))
    span = F.concat(F.date_format(F.when(k % 11 == 0, F.date_add(start, 7)).otherwise(start), "yyyy.MM.dd"), F.lit(" ~ "), F.date_format(F.date_add(start, 6), "yyyy.MM.dd"))
    page = F.concat(
        beside(-7, "left"), span, beside(7, "right"), F.lit("<table class='calendar_box wide'><thead><tr><th></th>"), *heads,
        F.lit("</tr></thead><tbody><tr><th>아침</th>"), *cells, F.lit("</tr><tr><th>notes</th><td>x</td></tr></tbody></table>"),
    )
    return table(spark, d, "customer").select("c_custkey", page.alias("html"))


WEEKS_SQL = """
w AS (
    SELECT c_custkey, c_name, DATE '2026-01-04' + (c_custkey % 50 * 7)::INT AS start,
        CASE WHEN c_custkey % 11 = 0 THEN 'weeks_differ' WHEN c_custkey % 13 = 0 THEN 'column_shifted' WHEN c_custkey % 17 = 0 THEN 'ragged_row' END AS failure FROM customer
)"""


@query(
    "week_meals",
    f"""
    WITH {WEEKS_SQL}
    SELECT c_custkey, start + i::INT AS date, 'breakfast' AS meal, CASE WHEN i IN (3, 6) THEN 'unknown' WHEN i IN (1, 2) THEN 'closed_temporary' ELSE 'operating' END AS status,
        CASE i WHEN 0 THEN 'white rice,' || c_name WHEN 4 THEN 'soup,' || c_name WHEN 5 THEN c_name ELSE '' END AS items,
        CASE i WHEN 1 THEN '[holiday]' WHEN 2 THEN '식사없음' END AS note, CASE WHEN i = 4 THEN 'encodings_differ' END AS quarantine
    FROM w, range(7) r(i) WHERE failure IS NULL
    """,
)
def week_meals(spark, d):  # noqa: ANN001, ANN201
    found, _ = week_table.meals(_week_pages(spark, d), "c_custkey")
    return found.withColumn("items", F.array_join("items", ","))


@query("week_failures", f"WITH {WEEKS_SQL} SELECT c_custkey, CASE WHEN failure IS NULL THEN start END AS start, failure FROM w")
def week_failures(spark, d):  # noqa: ANN001, ANN201
    pages = _week_pages(spark, d)
    return week_table.weeks(pages, week_table.table_rows(pages, "c_custkey"), "c_custkey")
