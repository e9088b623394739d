"""Week tables: what a page says of its week has to agree before any meal is read."""

from __future__ import annotations

import datetime as dt

from lodestrata.sources import week_table

DAYS = "일월화수목금토"


def page(start="2026-05-31", shown=None, before=None, after=None, header=0, cells=None, box="calendar_box", head="thead", label="점심"):  # noqa: ANN001, ANN201, PLR0913
    first = dt.date.fromisoformat(start)
    day = lambda n: (first + dt.timedelta(days=n)).isoformat()
    heads = "".join(f"<th>{DAYS[i]}요일\n ({(first + dt.timedelta(days=i + header)).day:02d}) <span>x</span></th>" for i in range(7))
    cells = "".join(f"<td>{c}</td>" for c in (cells or [""] * 7))
    shown = start.replace("-", ".") + " ~ 2026.06.06" if shown is None else shown
    return (
        f'<a href="?date={before or day(-7)}"><img src=left_btn.gif></a>{shown}<a href="?date={after or day(7)}"><img src=right_btn.gif></a>'
        f"<table class={box}><{head}><tr><th></th>{heads}</tr></{head}><tbody><tr><th>{label}</th>{cells}</tr></tbody></table>"
    )


def linked(body, title=""):  # noqa: ANN001, ANN201
    return f"<a class='x calendar_pop' title='{title}'>{body}</a>"


def failures(spark, pages):  # noqa: ANN001, ANN201
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows = week_table.table_rows(table)
    return {r["page_id"]: r["failure"] for r in week_table.weeks(table, rows).collect()}


def test_failures_by_name(spark):  # noqa: ANN001, ANN201
    pages = {
        page(): None,
        page(shown=""): None,
        page(box="other"): "no_table",
        page(head="tfoot"): "no_header",
        "<table class=calendar_box><thead><tr><th>일요일 (31)</tr></thead></table>": "no_week",
        page(shown="2026.13.41 ~ 2026.06.06"): "bad_date",
        page(before="2026-05-25"): "weeks_differ",
        page(shown="2026.06.01 ~ 2026.06.07"): "weeks_differ",
        page("2026-06-01"): "not_a_sunday",
        "2026.05.31 ~ 2026.06.06<table class=calendar_box><thead><tr><th>x</tr></thead></table>": "no_days",
        page(header=1): "column_shifted",
        page(cells=[""] * 6): "ragged_row",
        "": "no_table",
    }
    got = failures(spark, [*pages, None])
    assert got == dict(enumerate([*pages.values(), "no_table"]))
    assert set(pages.values()) - {None} == set(week_table.FAILURES)


def test_meals_of_cells(spark):  # noqa: ANN001, ANN201
    cells = [
        linked("boiled\n rice<br> soup &amp; salt <br/>", "boiled rice, soup & salt"), linked("식사없음"), linked("[local election]"), "", linked(" "),
        linked("a<br>b", "a"), "text without a link",
    ]
    table = spark.createDataFrame([(1, page(cells=cells)), (2, page(header=1, cells=cells)), (3, page(cells=cells, label="x")), (None, page(cells=cells))], "page_id long, html string")
    found, judged = week_table.meals(table)
    rows = sorted((r for r in found.collect() if r["page_id"] is not None), key=lambda r: r["date"])
    assert {r["page_id"] for r in rows} == {1}
    assert [r["date"] for r in rows] == [dt.date(2026, 5, 31) + dt.timedelta(days=i) for i in range(7)]
    assert [(r["status"], r["items"], r["note"], r["quarantine"]) for r in rows] == [
        ("operating", ["boiled rice", "soup & salt"], None, None),
        ("closed_temporary", [], "식사없음", None),
        ("closed_temporary", [], "[local election]", None),
        ("unknown", [], None, None),
        ("unknown", [], None, None),
        ("operating", ["a", "b"], None, "encodings_differ"),
        ("unknown", [], None, None),
    ]
    assert {r["page_id"]: r["failure"] for r in judged.collect() if r["page_id"] is not None} == {1: None, 2: "column_shifted", 3: None}


def test_empty(spark):  # noqa: ANN001, ANN201
    found, judged = week_table.meals(spark.createDataFrame([], "page_id long, html string"))
    assert found.count() == judged.count() == 0
