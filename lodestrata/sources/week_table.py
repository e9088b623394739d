"""Week tables: meals in rows, days in columns, the date of a column computed from the week's first day.

A page becomes a row per cell; the week, the alignment of its columns and the meals are expressions and
aggregates over cells.  A page whose week can't be trusted gives no meal at all but a named failure:
a table that is read one column off is well-formed, so only what the page says of itself tells.

Defined results
    null or empty pages have ``no_table``; only the first table of the class counts; the failures are
    named in the order of FAILURES, the first that holds; an empty cell is ``unknown``, not closed;
    a page with a null key gives no meal and counts as ``no_table``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import stored
from lodestrata.sources.dining import CLOSED, DAYS, MEALS
from lodestrata.sources.html import Node, parse, rows_of

#: How a page writes its week, the links to the weeks beside it, and the days of a header.
SHOWN = r"(\d{4})\.(\d{2})\.(\d{2})\s*~\s*\d{4}\.\d{2}\.\d{2}"
BESIDE = r'<a[^>]+href="[^"]*date=(\d{4}-\d{2}-\d{2})[^"]*"[^>]*>\s*<img[^>]+%s_btn'
HEADER = r"([월화수목금토일])요일\s*\((\d{1,2})\)"
BOX, LINK = "calendar_box", "calendar_pop"

FAILURES = ("no_table", "no_header", "no_week", "bad_date", "weeks_differ", "not_a_sunday", "no_days", "column_shifted", "ragged_row")
CELLS = "row int, col int, head boolean, text string, linked string, title string"


def _broken_lines(node: Node) -> str:
    """The text with line feeds for breaks alone."""
    parts, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            parts.append(re.sub(r"\s+", " ", at))
        elif at.tag == "br":
            parts.append("\n")
        else:
            stack.extend(reversed(at.children))
    return "".join(parts)


def _of_class(nodes: list[Node], name: str) -> Iterator[Node]:
    return (n for n in nodes if name in n.attrs.get("class", "").split())


def _cells(html: str, box: str, link: str) -> list[dict]:
    table = next(_of_class(parse(html).find("table"), box), None)
    found = []
    for row, tr in enumerate(table.find("tr") if table else []):
        for col, cell in enumerate(c for c in tr.children if not isinstance(c, str) and c.tag in ("td", "th")):
            a = next(_of_class(cell.find("a"), link), None)
            held = {"linked": a and _broken_lines(a), "title": a and a.attrs.get("title")}
            found.append({"row": row, "col": col, "head": tr.inside("thead"), "text": " ".join(cell.text().split()), **held})
    return found


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html", box: str = BOX, link: str = LINK) -> DataFrame:
    """key, row, head, meal (null if the row is none's) and cells (col, text, linked, title) of each row of a page's week table."""
    cells = rows_of(pages, lambda h: _cells(h, box, link), CELLS, key, html)
    held = F.sort_array(F.collect_list(F.struct("col", "text", "linked", "title")))
    rows = cells.groupBy(key, "row").agg(F.first("head").alias("head"), held.alias("cells"))
    label = F.create_map(*(F.lit(x) for pair in MEALS.items() for x in pair))[F.get("cells", F.lit(0))["text"]]
    return rows.select(key, "row", "head", F.when(~F.col("head"), label).alias("meal"), "cells")


def _signals(html: Column) -> Column:
    """What the page says of its first day: as it shows the week, and by the weeks before and after; null is no date."""
    part = lambda k: F.regexp_extract(html, SHOWN, k)
    told = ((F.concat_ws("-", part(1), part(2), part(3)), "--", 0), (F.regexp_extract(html, BESIDE % "left", 1), "", 7), (F.regexp_extract(html, BESIDE % "right", 1), "", -7))
    said = F.array(*(F.when(text != none, F.struct(F.date_add(text.try_cast("date"), days).alias("day"))) for text, none, days in told))
    return F.transform(F.filter(said, lambda s: s.isNotNull()), lambda s: s["day"])


def weeks(pages: DataFrame, rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, start and failure of each page, the latter null where the week holds."""
    days = lambda row: F.transform(row["cells"], lambda c: F.struct(F.regexp_extract(c["text"], HEADER, 1).alias("day"), F.regexp_extract(c["text"], HEADER, 2).try_cast("int").alias("of_month")))
    heads = F.sort_array(F.collect_list(F.when(F.col("head"), F.struct("row", "cells"))))
    found = rows.groupBy(key).agg(
        F.filter(F.flatten(F.transform(heads, days)), lambda c: c["day"] != "").alias("days"), F.max("head").alias("headed"),
        F.collect_set(F.when(F.col("meal").isNotNull(), F.size("cells") - 1)).alias("widths"),
    )
    said = pages.select(key, F.array_distinct(_signals(F.coalesce(html, F.lit("")))).alias("said")).withColumn("start", F.get("said", F.lit(0)))
    told = F.transform("days", lambda c, k: F.struct(F.date_add("start", k).alias("date"), c["day"].alias("day"), c["of_month"].alias("of_month")))
    fits = lambda c: (F.substring(F.lit(DAYS), F.dayofweek(c["date"]), F.lit(1)) == c["day"]) & (F.dayofmonth(c["date"]) == c["of_month"])
    holds = (
        F.col("headed").isNull(), ~F.col("headed"), F.size("said") == 0, F.exists("said", lambda s: s.isNull()), F.size("said") > 1, F.dayofweek("start") != 1,
        F.size("days") == 0, ~F.forall(told, fits), F.exists("widths", lambda n: n != F.size("days")),
    )
    first = F.coalesce(*(F.when(held, F.lit(name)) for name, held in zip(FAILURES, holds, strict=True)))
    judged = said.join(found, key, "left").select(key, "start", first.alias("failure"))
    return judged.select(key, F.when(F.col("failure").isNull(), F.col("start")).alias("start"), "failure")


def meals(pages: DataFrame, key: str = "page_id", html: str = "html", box: str = BOX, link: str = LINK) -> tuple[DataFrame, DataFrame]:
    """The meals and the weeks of pages.

    Meals: key, date, meal, status, items, note (why it is closed), quarantine (``encodings_differ`` where
    the cell's list and the title that repeats it are not the same).
    """
    rows = stored(table_rows(pages, key, html, box, link), "week_rows")
    judged = stored(weeks(pages, rows, key, html), "weeks")
    held = rows.where("meal is not null").join(judged.where("failure is null").select(key, "start"), key)
    held = held.select(key, "meal", "start", F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))).alias("k", "cell"))
    parts = lambda text, at: F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), at), lambda x: F.trim(x)), lambda x: x != "")
    held = held.select(key, "meal", F.date_add("start", F.col("k")).alias("date"), parts(F.col("cell.linked"), "\n").alias("lines"), parts(F.col("cell.title"), ",").alias("titles"))
    alone = F.when(F.size("lines") == 1, F.get("lines", F.lit(0)))
    closed = F.array_join("lines", "").isin(*CLOSED) | F.coalesce(F.regexp_like(alone, F.lit(r"^\[.+\]$")), F.lit(False))
    bare = lambda texts: F.transform(texts, lambda x: F.regexp_replace(x, r"\s+", ""))
    held = held.withColumn("status", F.when(F.size("lines") == 0, "unknown").when(closed, "closed_temporary").otherwise("operating"))
    serves = F.col("status") == "operating"
    return held.select(
        key, "date", "meal", "status", F.when(serves, F.col("lines")).otherwise(F.array().cast("array<string>")).alias("items"),
        F.when(F.col("status") == "closed_temporary", F.get("lines", F.lit(0))).alias("note"),
        F.when(serves & (F.size("titles") > 0) & (bare("lines") != bare("titles")), "encodings_differ").alias("quarantine"),
    ), judged
