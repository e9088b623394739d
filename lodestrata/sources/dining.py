"""Dining pages: tables in page order below the heading of their place, as hours, menus and prices.

A page becomes a row per cell, spans written out; everything after that is joins and aggregates over
cells.  A heading is no ancestor of its tables but stands before them, so each cell carries the
heading last met.  Closures that a page states are rows; an empty cell is unknown, not closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.html import MOST_SPAN, parse, rows_of, span

#: Labels of meals, marks of closed days, and how times, dates and amounts are written.
MEALS = {"조식": "breakfast", "점심": "lunch", "석식": "dinner", "아침": "breakfast", "중식": "lunch", "저녁": "dinner"}
CLOSED = ("운영없음", "미운영", "식사없음")
TIMES = r"(\d{1,2}:\d{2})\s*~\s*(\d{1,2}:\d{2})"
DATED = r"([월화수목금토일])요일\s*(\d{4}-\d{2}-\d{2})"
AMOUNT = r"([\d,]+)\s*원"
AUDIENCE = r"(구성원|외부인)\s*[:：]\s*([\d,]+)\s*원"
DAYS = "일월화수목금토"
HOLIDAY = 7

CELLS = "place string, number int, row int, col int, text string, date string, spread boolean, first boolean"


def _cells(html: str, heading: str) -> list[dict]:
    found, place, number = [], None, -1
    for node in parse(html).walk():
        if node.tag == "p" and heading in node.attrs.get("class", "").split():
            place = " ".join(node.text().split())
        if node.tag != "table" or place is None:
            continue
        number += 1
        taken: set[tuple[int, int]] = set()
        for row, tr in enumerate(node.find("tr")):
            col = 0
            for cell in (c for c in tr.children if not isinstance(c, str) and c.tag in ("td", "th")):
                while (row, col) in taken:
                    col += 1
                wide, deep = span(cell, "colspan", MOST_SPAN), span(cell, "rowspan", MOST_SPAN)
                base = {"place": place, "number": number, "text": cell.text(), "date": cell.attrs.get("data-date"), "spread": wide > 1}
                for down in range(deep):
                    for right in range(wide):
                        taken.add((row + down, col + right))
                        found.append(base | {"row": row + down, "col": col + right, "first": not down and not right})
                col += wide
    return found


def cells(pages: DataFrame, key: str = "page_id", html: str = "html", heading: str = "title") -> DataFrame:
    """Cells of each table that stands below a heading (a paragraph of that class): key, place (the
    heading), number of the table, row, col, text, the date of its own, whether it spreads over columns."""
    return rows_of(pages, lambda h: _cells(h, heading), CELLS, key, html)


def _meal(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MEALS.items() for x in pair))[label]


def hours(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """key, place, meal, weekday (0 Sunday, 7 holidays), open, close, closed: of rows that begin with a meal."""
    order = F.sort_array(F.collect_list(F.struct("col", "text")))
    rows = cells.where("first").groupBy(key, "place", "number", "row").agg(order.alias("cells"))
    body = F.array_join(F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: c["text"]), " ")
    rows = rows.select(key, "place", _meal(F.col("cells")[0]["text"]).alias("meal"), body.alias("body")).where("meal is not null")
    open_, close = (F.nullif(F.regexp_extract("body", TIMES, k), F.lit("")) for k in (1, 2))
    said = lambda word, days: F.when(F.contains("body", F.lit(word)), F.array(*map(F.lit, days))).otherwise(F.array().cast("array<int>"))
    stated = F.when(F.contains("body", F.lit("미운영")), F.concat(said("주말", (0, 6)), said("공휴일", (HOLIDAY,)))).otherwise(F.array().cast("array<int>"))
    served = rows.where(open_.isNotNull()).select(key, "place", "meal", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("weekday"), open_.alias("open"), close.alias("close"), F.lit(False).alias("closed"))
    none = F.lit(None).cast("string")
    shut = rows.select(key, "place", "meal", F.explode(stated).alias("weekday"), none.alias("open"), none.alias("close"), F.lit(True).alias("closed"))
    return served.unionByName(shut)


def menus(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """key, place, date, weekday, meal, corner, status, items: columns under a dated header, unpivoted.

    ``aligned`` is false where a cell that is a single column names another date than its header.
    """
    by = [key, "place", "number"]
    head = cells.where("row = 0").select(*by, "col", F.regexp_extract("text", DATED, 1).alias("day"), F.nullif(F.regexp_extract("text", DATED, 2), F.lit("")).alias("head_date"))
    head = head.where("head_date is not null")
    labels = head.groupBy(*by).agg(F.min("col").alias("from"))
    below = cells.where("row > 0").join(labels, by)
    named = below.where(F.col("col") < F.col("from")).groupBy(*by, "row").agg(
        F.min_by(_meal(F.col("text")), F.when(_meal(F.col("text")).isNotNull(), F.col("col"))).alias("meal"),
        F.max_by("text", "col").alias("last"),
    )
    named = named.where("meal is not null").withColumn("corner", F.when(_meal(F.col("last")).isNull(), F.col("last")).otherwise(""))
    text = F.trim(F.coalesce("text", F.lit("")))
    parts = F.transform(F.split(text, "[\n/]"), lambda x: F.trim(x))
    status = F.when(text == "", "unknown").when(text.isin(*CLOSED), "closed_temporary").otherwise("operating")
    out = below.join(head, [*by, "col"]).join(named.drop("last"), [*by, "row"])
    return out.select(
        key, "place", F.col("head_date").cast("date").alias("date"), (F.instr(F.lit(DAYS), F.col("day")) - 1).alias("weekday"), "meal", "corner", status.alias("status"),
        F.when(status == "operating", F.filter(parts, lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("items"),
        (F.col("spread") | F.col("date").isNull() | (F.col("date") == F.col("head_date"))).alias("aligned"),
    )


def prices(cells: DataFrame, key: str = "page_id") -> DataFrame:
    """key, place, name, audience, price_text, price_min, price_max of tables with a price column, and
    of tables that name amounts by audience alone."""
    by = [key, "place", "number"]
    column = lambda name: F.max(F.when((F.col("row") == 0) & (F.col("text") == name), F.col("col")))
    columns = cells.groupBy(*by).agg(column("단가").alias("price_col"), column("메뉴").alias("name_col"))
    at = lambda alias: F.max(F.when(F.col("col") == F.col(alias), F.col("text")))
    listed = cells.where("row > 0").join(columns.where("price_col is not null"), by)
    listed = listed.groupBy(*by, "row").agg(at("price_col").alias("price_text"), at("name_col").alias("name"))
    won = F.transform(F.regexp_extract_all("price_text", F.lit(AMOUNT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("int"))
    listed = listed.where((F.size(won) > 0) & (F.coalesce("name", F.lit("")) != ""))
    most = F.when((F.size(won) == 1) & F.contains("price_text", F.lit("부터")), F.lit(None)).otherwise(F.array_max(won))
    sheet = listed.select(key, "place", "name", F.lit("전체").alias("audience"), "price_text", F.array_min(won).alias("price_min"), most.alias("price_max"))
    plain = cells.where("first").join(columns.where("price_col is null"), by).groupBy(*by)
    order = F.sort_array(F.collect_list(F.struct("row", "col", "text")))
    plain = plain.agg(F.array_join(F.transform(order, lambda c: c["text"]), " ").alias("all"), F.array_join(F.transform(F.filter(order, lambda c: c["row"] == 0), lambda c: c["text"]), " ").alias("name"))
    said = lambda group: F.regexp_extract_all("all", F.lit(AUDIENCE), F.lit(group))
    plain = plain.select(key, "place", "name", F.explode(F.arrays_zip(said(1).alias("who"), said(2).alias("won"))).alias("x"))
    value = F.replace(F.col("x.won"), F.lit(","), F.lit("")).try_cast("int")
    return sheet.unionByName(plain.select(key, "place", "name", F.col("x.who").alias("audience"), F.concat("x.won", F.lit("원")).alias("price_text"), value.alias("price_min"), value.alias("price_max")))


def complete(hours: DataFrame, key: str = "page_id") -> DataFrame:
    """Places whose every meal has all seven weekdays: only there does a missing row mean closed."""
    days = hours.where(F.col("weekday") < HOLIDAY).groupBy(key, "place", "meal").agg(F.count_distinct("weekday").alias("days"))
    return days.groupBy(key, "place").agg((F.min("days") == len(DAYS)).alias("complete"))
