"""Operators on small literal tables."""

from __future__ import annotations

import datetime as dt
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import dates, predicates, text
from lodestrata.operators import corpus, decisions, facts, reconcile, search, search_index, upsert, validate
from lodestrata.sources import dining, files, hwp, html, links, sheets


def one(spark, expression, **columns):  # noqa: ANN001, ANN003, ANN201
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("question", "want"),
    [("휴학은 어떻게 해요", ["휴학"]), ("A+ 기준", ["A+", "기준"]), ("자퇴하려면 자퇴", ["자퇴"]), ("", []), ("개요 필요", ["개요", "필요"]), ("2024+ 학점", ["2024", "학점"])],
)
def test_tokens(spark, question, want):  # noqa: ANN001, ANN201
    assert one(spark, text.tokens(F.col("q")), q=question) == want


def test_tokens_are_eight_at_most(spark):  # noqa: ANN001, ANN201
    assert len(one(spark, text.tokens(F.col("q")), q=" ".join(f"word{chr(97 + i)}" for i in range(12)))) == 8


@pytest.mark.parametrize(
    ("t", "want"),
    [("1-2", False), ("더보기", False), ("기간: 3월", True), ("신청할 수 있다.", True), ("월간 일정", False), ("이것은 꽤 긴 세 낱말 이름", True), ("", False)],
)
def test_self_contained(spark, t, want):  # noqa: ANN001, ANN201
    assert one(spark, predicates.self_contained(F.col("t")), t=t) is want


def test_word_boundaries(spark):  # noqa: ANN001, ANN201
    assert one(spark, text.wordwise_contains(F.col("t"), "공지"), t="인공지능") is False
    assert one(spark, text.wordwise_contains(F.col("t"), "공지"), t="공지사항") is True
    assert one(spark, text.starts_word(F.col("t"), "시험"), t="종합시험 언제") is False
    assert one(spark, text.starts_word(F.col("t"), "시험"), t="시험기간") is True


@pytest.mark.parametrize(("w", "want"), [("휴학", "은"), ("학교", "는"), ("3", "은"), ("2", "는"), ("?", "는")])
def test_particles(spark, w, want):  # noqa: ANN001, ANN201
    assert one(spark, text.particle(F.col("w"), "은", "는"), w=w) == want


def test_particle_after_l(spark):  # noqa: ANN001, ANN201
    assert one(spark, text.particle(F.col("w"), "으로", "로"), w="서울") == "로"
    assert one(spark, text.particle(F.col("w"), "으로", "로"), w="집") == "으로"


def test_small_talk(spark):  # noqa: ANN001, ANN201
    assert [one(spark, predicates.small_talk(F.col("t")), t=t) for t in ("안녕하세요!", "고마워", "ㅋㅋㅋ", "안녕하세요 휴학")] == ["greeting", "thanks", "chitchat", None]


def test_text_pieces(spark):  # noqa: ANN001, ANN201
    assert one(spark, text.grams(F.col("t")), t="ab") == []
    assert one(spark, text.grams(F.col("t")), t="abcd") == ["abc", "bcd"]
    assert one(spark, text.normalized_name(F.col("t")), t=" 돈까스 (대) [A] ") == "돈까스대A"
    assert one(spark, text.cell_items(F.col("t")), t="쌀밥 국\n김치/나물") == ["쌀밥 국", "김치", "나물"]
    assert one(spark, text.without_leading_title(F.col("t"), F.lit("휴학 안내")), t="[휴학-안내] 본문") == "본문"
    assert one(spark, text.longest_common(F.col("a"), F.col("b")), a="xabcy", b="zabcq") == "abc"
    assert one(spark, text.without_words(F.col("t"), F.array(F.lit("a"), F.lit("abc"))), t="abc x a") == "x"


def test_calendar_and_tables(spark):  # noqa: ANN001, ANN201
    assert one(spark, predicates.calendar_widget(F.col("t")), t="월 | 화 | 수 | 목 | 금 | 토 | 일") is True
    assert one(spark, predicates.calendar_widget(F.col("t")), t="월 | 화 | 수") is False
    assert one(spark, predicates.ragged(F.col("t")), t="a|b\nc") is True


def test_dates(spark):  # noqa: ANN001, ANN201
    day = lambda t: one(spark, dates.flexible_date(F.col("t"), 2026), t=t)
    assert day("2026.9.1") == dt.date(2026, 9, 1)
    assert day("9/1") == dt.date(2026, 9, 1)
    assert day("2/30") is None
    assert day("9월 초") is None
    deadline = lambda t, p: one(spark, dates.title_deadline(F.col("t"), F.lit(p).cast("date")), t=t)
    assert deadline("모집 (~1/5)", "2025-12-20") == dt.date(2026, 1, 5)
    assert deadline("모집 (~8.9)", "2026-08-10") == dt.date(2026, 8, 9)
    assert deadline("8.9(일)까지", "2026-08-01") == dt.date(2026, 8, 9)
    assert one(spark, dates.relative_day(F.col("t"), F.lit("2026-08-10").cast("date")), t="내일 점심") == dt.date(2026, 8, 11)
    assert one(spark, dates.asked_days(F.col("t")), t="400일") == 90


def test_price_text(spark):  # noqa: ANN001, ANN201
    assert tuple(one(spark, sheets.price(F.col("t")), t="5,000~6,000")) == ("5,000~6,000", 5000, 6000)
    assert tuple(one(spark, sheets.price(F.col("t")), t="4,500원부터")) == ("4,500원부터", 4500, None)


def test_price_join_matches_one_of_four(spark):  # noqa: ANN001, ANN201
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    prices = spark.createDataFrame([("a", 2, 900), ("a", 1, 1000), ("aa", 1, 5)], "name string, rank int, price int")
    got = {r["name"]: (r["price"], r["others"]) for r in facts.ranked_exact_join(items, prices, "name", F.col("rank"), [F.col("price")], "price", F.col("price").cast("string")).collect()}
    assert got == {"a": (1000, ["900"]), "b": (None, []), "c": (None, []), "d": (None, [])}


def test_reconcile_never_invents(spark):  # noqa: ANN001, ANN201
    shape = "k int, items array<string>, observed boolean"
    a = spark.createDataFrame([(1, ["x"], True), (2, [], False), (3, ["p"], True), (5, [], False)], shape)
    b = spark.createDataFrame([(1, ["y"], True), (2, ["z"], True), (4, ["q"], True), (5, [], False)], shape)
    both = reconcile.compare(a, b, ["k"], "items", "observed")
    assert {r["k"]: r["result"] for r in both.collect()} == {1: "conflict", 2: "secondary_only", 3: "primary_only", 4: "secondary_only", 5: "silent"}
    merged = {r["k"]: (r["items"], r["origin"], r["conflict"]) for r in reconcile.merge(both, ["k"]).collect()}
    assert merged == {1: (["x"], "primary", True), 2: (["z"], "secondary", False), 3: (["p"], "primary", False), 4: (["q"], "secondary", False), 5: ([], "primary", False)}


def test_meal_rules(spark):  # noqa: ANN001, ANN201
    shape = "meal_type string, service_status string, date string, zone string, corner string, items array<string>"
    rows = [("lunch", "operating", "2026-08-10", "", "", ["a"]), ("brunch", "operating", "2026-08-10", "", "", ["a"]), ("lunch", "closed", "2026-08-10", "", "", ["a"]),
            ("lunch", "operating", "x", "", "", ["a"]), ("lunch", "operating", "2026-08-10", None, "", ["a"]), ("lunch", "operating", "2026-08-10", "", "", []),
            ("lunch", "operating", "2026-08-10", "", "", ["a b c d e f g"]), ("lunch", "operating", "2026-08-10", "", "", ["a", "a", "a"])]
    reason = validate.first_failure(validate.meal_rules(["lunch"], ["operating", "closed"]))
    got = [r["r"] for r in spark.createDataFrame(rows, shape).coalesce(1).select(reason.alias("r")).collect()]
    assert got == [None, "meal_type", "items_of_closed", "date", "key", "no_items", "one_blob", "repeated"]


@pytest.mark.parametrize(
    ("hours", "term", "complete", "want"),
    [
        ([], None, True, None),
        ([("2026-08-01", "lunch", "spring", False)], None, False, None),
        ([("2026-08-01", "lunch", "spring", False)], "spring", False, True),
        ([("2026-08-01", "lunch", "spring", True)], "spring", False, False),
        ([("2026-08-01", "dinner", "spring", False)], "spring", False, None),
        ([("2026-08-01", "dinner", "spring", False)], "spring", True, False),
        ([("2026-08-01", "lunch", "unspecified", False)], "spring", True, None),
        ([("2026-08-01", "lunch", "unspecified", True)], None, False, False),
        ([("2026-08-01", "lunch", "spring", True), ("2026-08-01", "lunch", "autumn", False)], None, False, None),
        ([("2026-08-01", "lunch", "spring", True), ("2026-08-01", "lunch", "autumn", True)], None, False, False),
        ([("2026-07-01", "lunch", "spring", True), ("2026-08-01", "lunch", "spring", False)], "spring", False, True),
    ],
)
def test_serves(spark, hours, term, complete, want):  # noqa: ANN001, ANN201
    day = dt.date(2026, 8, 10)  # a Monday
    rows = [(1, dt.date.fromisoformat(f), 1, meal, t, closed) for f, meal, t, closed in hours]
    table = spark.createDataFrame(rows, "facility int, valid_from date, weekday int, meal string, term string, closed boolean")
    asked = spark.createDataFrame([(1, day, "lunch", term)], "facility int, day date, meal_asked string, term_asked string")
    coverage = spark.createDataFrame([(1, complete)], "facility int, complete boolean")
    assert decisions.serves(asked, table, coverage).first()["serves"] is want


def test_upsert_changes_listed_columns_only(spark):  # noqa: ANN001, ANN201
    old = spark.createDataFrame([(1, "a", "s", 5)], "k int, v string, kept string, sticky int")
    new = spark.createDataFrame([(1, "b", "t", None), (2, "c", "u", 7)], "k int, v string, kept string, sticky int")
    got = sorted(map(tuple, upsert.upsert_listed(old, new, ["k"], ["v"], ("sticky",)).collect()))
    assert got == [(1, "b", "s", 5), (2, "c", "u", 7)]


def test_boilerplate_abstains_and_finds(spark):  # noqa: ANN001, ANN201
    def found(n: int) -> dict:
        rows = [("p", i, "a shared survey block") for i in range(n)] + [("p", i, f"body of page number {i}") for i in range(n)]
        made = corpus.fragments(spark.createDataFrame(rows, "profile string, page int, text string"), "profile", "page", "text")
        return made, {r["text"]: r["kind"] for r in corpus.boilerplate(made).collect()}

    assert found(3)[1] == {}
    pages, kinds = found(10)
    assert kinds == {"a shared survey block": "boilerplate"}
    assert corpus.prune(pages, corpus.boilerplate(pages)).count() == 10


def test_identical_pages_are_held(spark):  # noqa: ANN001, ANN201
    rows = spark.createDataFrame([("p", i, "all there is here") for i in range(10)], "profile string, page int, text string")
    made = corpus.fragments(rows, "profile", "page", "text")
    assert corpus.prune(made, corpus.boilerplate(made)).where("held").count() == 10


def test_segmentation(spark):  # noqa: ANN001, ANN201
    split = corpus.segmenter({"수강": 50, "신청": 40, "기간": 30, "수강신청": 10})
    got = [one(spark, split(F.col("w")), w=w) for w in ("수강신청기간", "수강신청", "수강", "수강신청표")]
    assert got == [["수강신청", "기간"], None, None, None]


def test_cliques_need_every_pair(spark):  # noqa: ANN001, ANN201
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("x", "z"), ("y", "z")], "a string, b string")
    weights = spark.createDataFrame([(n, w) for w, n in enumerate("zyxcba")], "name string, weight long")
    assert sorted(map(tuple, corpus.cliques(pairs, weights).collect())) == [("a", "a"), ("a", "b"), ("x", "x"), ("x", "y"), ("x", "z")]
    assert corpus.cliques(pairs.limit(0), weights).count() == 0


def test_cliques_read_their_pairs_once(spark):  # noqa: ANN001, ANN201
    """The first fit by weight, and the pairs, which may be dear to make, are made a single time."""
    import random

    rng, made = random.Random(5), spark.sparkContext.accumulator(0)
    names = [f"n{k:02d}" for k in range(24)]
    pairs = [(a, b) for a in names for b in names if a < b and rng.random() < 0.6]
    weights = [(n, rng.randint(1, 5)) for n in names]

    def counted(rows):  # noqa: ANN001, ANN202
        for batch in rows:
            made.add(len(batch))
            yield batch

    frame = spark.createDataFrame(pairs, "a string, b string").mapInPandas(counted, "a string, b string")
    groups: list[list[str]] = []
    for name, _ in sorted(weights, key=lambda x: (-x[1], x[0])):
        home = next((g for g in groups if all((min(name, m), max(name, m)) in pairs for m in g)), None)
        groups.append([name]) if home is None else home.append(name)
    got = corpus.cliques(frame, spark.createDataFrame(weights, "name string, weight long")).collect()
    assert sorted(map(tuple, got)) == sorted((g[0], m) for g in groups if len(g) > 1 for m in g)
    assert made.value == len(pairs)


def test_sections_look_up_only_from_what_they_read(monkeypatch):  # noqa: ANN001, ANN201
    """Cells and rows don't walk to the top of the page; what lies in skipped parts stays out."""
    from lodestrata.sources import html

    asked, inside = [], html.Node.inside
    monkeypatch.setattr(html.Node, "inside", lambda node, *tags: asked.append(node.tag) or inside(node, *tags))
    rows = "".join(f"<tr><td>{k}<td>a  b<br>c {k}</tr>" for k in range(100))
    found = html.sections(f"<nav><table><tr><td>x<tr><td>y</table></nav><h2>T</h2><table><tr><th>no<th>what</tr>{rows}</table>")
    assert [r["text"] for r in found if r["kind"] == "table_row"] == [f"T: no: {k} | what: a b\nc {k}" for k in range(100)]
    assert len(asked) < 10


def test_rare_tokens_draw_candidates():  # noqa: ANN201
    assert search.probes(1000, {"신청": 300, "복학": 5}) == ["복학"]
    assert search.probes(10, {"a": 5, "b": 6}) == ["a", "b"]


def test_spans():  # noqa: ANN201
    rows = "<table><tr><th>h<th colspan=2>w</tr><tr><td rowspan=2>a<td>b<td>c</tr><tr><td>d<td>e</tr></table>"
    assert [[t for t, _ in r] for r in html.grid(html.parse(rows).find("table")[0])] == [["h", "w", "w"], ["a", "b", "c"], ["a", "d", "e"]]
    absurd = html.parse("<table><tr><td colspan=9999>x</td></tr></table>").find("table")[0]
    assert len(html.grid(absurd)[0]) == html.MOST_SPAN
    broken = html.parse('<table><tr><td colspan="no">x</td></tr></table>').find("table")[0]
    assert len(html.grid(broken)[0]) == 1


def test_sections_quote_tables_and_lists():  # noqa: ANN201
    page = "<h2>Rules</h2><table><tr><th>Kind<th>Term</tr><tr><td>Leave<td>March</tr></table><ul><li>one<ul><li>inner</ul><li>two</ul><p>too short<p>a paragraph that is long enough to be one</p><dl><dt>a<dd>b<dt>c<dd>d</dl>"
    got = [(r["kind"], r["is_leaf"], r["text"]) for r in html.sections(page)]
    assert ("table_row", True, "Rules: Kind: Leave | Term: March") in got
    assert ("list_item", True, "inner") in got
    assert ("definition", True, "a: b") in got
    assert ("paragraph", True, "a paragraph that is long enough to be one") in got
    assert not any("too short" == t for _, _, t in got)


def test_boards_and_calendars():  # noqa: ANN201
    row = '<tr><td><a href="/v?id={0}">Notice {0}</a></td><td>2026.8.{0}</td></tr>'
    assert html.is_board("<table>" + "".join(row.format(i) for i in range(1, 5)) + "</table>")
    assert html.board(row.format(3))[0] == {"title": "Notice 3", "link": "/v?id=3", "published_at": "2026-08-03"}
    assert html.calendar("<dl><dt>3.2<dd>Start</dl>") == [{"when": "3.2", "title": "Start", "error": ""}]
    assert html.calendar("<dl><dt>3.2<dt>3.3<dd>x</dl>")[0]["error"] == "unpaired"


def test_variants(spark):  # noqa: ANN001, ANN201
    sources = spark.createDataFrame([("a", 2025), ("a", 2026), ("b", None)], "k string, year int")
    got = sorted(map(tuple, files.variants(sources, "year", 1, 0, [1, 2]).collect()))
    assert got == [("a", y, s) for y in (2024, 2025, 2026) for s in (1, 2)]
    assert files.variants(sources.withColumnRenamed("year", "ac_year"), "ac_year", 0, 0, [1]).columns == ["k", "ac_year", "ac_semester"]


def test_sheets_keep_quotes(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = [("2026-3-1", 'a "quoted", text\nof two lines', "x"), ("2026-3-2", '"', None)]
    files.write_csv(spark.createDataFrame(rows, "day string, title string, more string"), str(tmp_path / "sheet"))
    got = sheets.read_sheet(spark, str(tmp_path / "sheet"), {"day": "day", "title": "title", "more": "more"}, ["day"])
    assert sorted(map(tuple, got.collect())) == rows


def test_zipped_documents(spark, tmp_path):  # noqa: ANN001, ANN201
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("Contents/section0.xml", "<s xmlns:h='u'><h:p><h:run><h:t>제1조 목적</h:t></h:run></h:p><h:p><h:t>본문</h:t></h:p></s>")
    (tmp_path / "a.hwpx").write_bytes(made.getvalue())
    (tmp_path / "b.hwpx").write_bytes(b"PK broken")
    found = hwp.read_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r["text"] for r in sorted(found, key=lambda r: (r["path"], r["ordinal"])) if r["text"]] == ["제1조 목적", "본문"]
    assert sum(r["error"] is not None for r in found) == 1
    assert hwp.articles(["머리", "제1조 목적", "본문"]) == [("", ["머리"]), ("제1조 목적", ["본문"])]


def test_records():  # noqa: ANN201
    payload = "가나\t".encode("utf-16-le")[:4] + struct.pack("<8H", 9, 0, 0, 0, 0, 0, 0, 9) + "다".encode("utf-16-le")
    stream = struct.pack("<I", hwp.PARAGRAPH_TEXT | len(payload) << 20) + payload + struct.pack("<I", 66 | 100 << 20)
    assert [(tag, hwp.paragraph(p)) for tag, _, p in hwp.records(stream)] == [(hwp.PARAGRAPH_TEXT, "가나\t다")]
    assert zlib.decompress(zlib.compress(stream)) == stream


def test_links(spark):  # noqa: ANN001, ANN201
    base = "https://a.example.org/x/y.do?z=1"
    normal = lambda u: one(spark, links.normalize(F.col("u"), F.lit(base), "example.org"), u=u)
    assert normal("/p/list.do#top") == "https://a.example.org/p/list.do"
    assert normal("q.do") == "https://a.example.org/x/q.do"
    assert normal("https://b.example.org") == "https://b.example.org/"
    assert [normal(u) for u in ("javascript:x()", "#a", "file.pdf", "/login.do", "https://other.org/")] == [None] * 5
    assert one(spark, links.classify(F.col("u")), u="https://a/b/artclView.do") == "board_detail"


def test_sheets(spark, tmp_path):  # noqa: ANN001, ANN201
    (tmp_path / "s.csv").write_text("﻿게시일(필수),제목 ,내용\n2026.8.1, 첫 글 ,x\n미정,둘째,y\n8/2,,z\n", encoding="utf-8")
    named = {"게시일": "published_at", "제목": "title", "내용": "body"}
    good, bad = sheets.posts(sheets.read_sheet(spark, str(tmp_path / "s.csv"), named, ["title"]), 2026)
    assert [r["title"] for r in good.collect()] == ["첫 글"]
    assert sorted(r["reason"] for r in bad.collect()) == ["no_date", "no_title"]
    with pytest.raises(sheets.MissingHeader):
        sheets.read_sheet(spark, str(tmp_path / "s.csv"), named, ["deadline"])


def test_snapshots(spark, tmp_path):  # noqa: ANN001, ANN201
    at = dt.datetime(2026, 8, 1)
    rows = [("s", "u", at, 200, "text/html", bytearray(b"<a href='x.css?ver=1'>")), ("s", "u", at + dt.timedelta(1), 200, "text/html", bytearray(b"<a href='x.css?ver=2'>"))]
    files.save_snapshots(spark.createDataFrame(rows, files.SNAPSHOT), str(tmp_path / "snap"))
    saved = files.load_snapshots(spark, str(tmp_path / "snap"))
    assert saved.select("stable_hash").distinct().count() == 1
    assert saved.select("content_hash").distinct().count() == 2
    assert files.last_snapshots(saved).first()["fetched_at"] == at + dt.timedelta(1)
    assert files.usage(spark, str(tmp_path / "snap"), "*.parquet").first()["files"] >= 1


def test_stored_index_answers_like_a_scan(spark, tmp_path):  # noqa: ANN001, ANN201
    words = ["library", "Library+", "hours", "fee", "library's", "x", ""]
    rows = [(p, k, f"h{p % 3}", f"path {words[p % 5]}", " ".join(words[(p * k + j) % 7] for j in range(4))) for p in range(30) for k in range(5)]
    sections = spark.createDataFrame([*rows, (99, 0, None, None, None)], "page long, ordinal int, host string, path string, text string")
    search_index.build_index(sections, str(tmp_path / "ix"))
    index = search_index.open_index(spark, str(tmp_path / "ix"))
    place = lambda found: sorted((r["page"], r["ordinal"]) for r in found.collect())
    for host in (None, "h1"):
        stored, scan = index.on(host), search.Scan(sections).on(host)
        assert stored.totals()[0] == scan.totals()[0]
        assert stored.totals()[1] == pytest.approx(scan.totals()[1], rel=0.02)
        for tokens in (["ibra"], ["FEE", "y+"], ["zz"], ["x", "hours"]):
            assert stored.frequencies(tokens) == scan.frequencies(tokens)
            for in_path in (True, False):
                assert place(stored.holding(tokens, in_path)) == place(scan.holding(tokens, in_path))
    assert search._source(index, ["y's"]).frequencies(["y's"]) == search.Scan(sections).frequencies(["y's"])


def test_stored_index_of_many_pages(spark, tmp_path, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(search_index, "NAMED", 5)
    sections = spark.createDataFrame([(p, 0, "h", "top", f"word{p} same") for p in range(40)], "page long, ordinal int, host string, path string, text string")
    search_index.build_index(sections, str(tmp_path / "ix"))
    index = search_index.open_index(spark, str(tmp_path / "ix"))
    assert index.frequencies(["word", "same"]) == {"word": 40, "same": 40}
    assert index.holding(["word"]).count() == 40


def test_title_synonyms_need_all_four_conditions(spark):  # noqa: ANN001, ANN201
    same, other = "apply for the grant at the office before the day", "menu soup rice fish noodles bread"
    rows = [
        *(("scholarship guide", f"a{k}", same) for k in range(3)),
        *(("scholarship info", f"b{k}", same) for k in range(3)),
        *(("scholarship meals", f"c{k}", other) for k in range(3)),  # other contents
        *(("zq", f"d{k}", same) for k in range(3)),  # no run of characters in common
        *(("scholarships", f"a{k}", same) for k in range(3)),  # on the same sites as the first
        *(("scholarship page", f"e{k}", same) for k in range(2)),  # on two sites
    ]
    found = corpus.title_synonyms(spark.createDataFrame(rows, "title string, host string, text string"))
    assert sorted((r["a"], r["b"], r["common"]) for r in found.collect()) == [
        ("scholarship guide", "scholarship info", "scholarship"), ("scholarship info", "scholarships", "scholarship"),
    ]


def test_title_synonyms_against_all_pairs(spark, monkeypatch):  # noqa: ANN001, ANN201
    """Titles of which many share a run of characters, dealt to several tasks, none of them through the pairs that share words."""
    import random

    monkeypatch.setattr(corpus, "MET", 4)
    monkeypatch.setattr(corpus, "overlapping_pairs", lambda *_: pytest.fail("pairs by words are met before the sites are looked at"))
    rng = random.Random(3)
    titles = {f"{rng.choice(['the', 'gran', 'x'])}{rng.choice('abcd')}{k}": ({f"h{j}" for j in rng.sample(range(12), rng.randint(2, 5))}, {f"w{j}" for j in rng.sample(range(12), 4)}) for k in range(80)}
    rows = [(t, h, " ".join(sorted(words))) for t, (hosts, words) in titles.items() for h in sorted(hosts)] + [("  ", "h1", "w1"), (None, "h1", "w1"), ("the", None, "w1")]
    runs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = {
        (a, b, len(titles[a][0]), len(titles[b][0]), len(titles[a][1] & titles[b][1]) / 4)
        for a in titles for b in titles
        if a < b and min(len(titles[a][0]), len(titles[b][0])) >= 3 and runs(a) & runs(b) and not titles[a][0] & titles[b][0] and len(titles[a][1] & titles[b][1]) >= 1
    }
    found = corpus.title_synonyms(spark.createDataFrame(rows, "title string, host string, text string")).collect()
    assert {(r["a"], r["b"], r["sites_a"], r["sites_b"], r["overlap"]) for r in found} == want
    assert len(found) == len(want) > 10


def test_overlapping_pairs_against_all_pairs(spark):  # noqa: ANN001, ANN201
    import random

    rng = random.Random(2)
    sets = {f"s{k}": sorted(rng.sample([f"w{j}" for j in range(25)], rng.randint(1, 12))) for k in range(40)}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / min(len(sets[a]), len(sets[b])) >= 0.5}
    got = corpus.overlapping_pairs(spark.createDataFrame(list(sets.items()), "k string, words array<string>"), "k", "words", 0.5)
    assert {(r["a"], r["b"]) for r in got.collect()} == want


DINING = """
<p class="title">North hall</p>
<table><tr><td>점심</td><td>평일 11:30 ~ 14:00</td><td>주말·공휴일 미운영</td></tr><tr><td>석식</td><td>17:00~18:30</td></tr></table>
<div><table><tr><th>구분</th><th>코너</th><th>월요일 2026-03-02</th><th>화요일 2026-03-03</th><th>수요일 2026-03-04</th></tr>
<tr><td rowspan="2">중식</td><td>A</td><td data-date="2026-03-02">rice<br>egg / soup</td><td data-date="2026-03-09">noodles</td><td>미운영</td></tr>
<tr><td>B</td><td colspan="3" data-date="2026-03-02">curry</td></tr><tr><td>석식</td><td>석식</td><td></td><td>stew</td><td>x</td></tr></table></div>
<p class="title">Price list</p>
<table><tr><th>분류</th><th>코너</th><th>메뉴</th><th>단가</th></tr><tr><td rowspan="2">set</td><td>C</td><td>cutlet</td><td>6,000원 - 6,500원</td></tr><tr><td>C</td><td>udon</td><td>5,000원 부터</td></tr></table>
<p class="title">South hall</p><table><tr><td>meal of the day</td></tr><tr><td>구성원 : 7,000원 외부인 : 8,500원</td></tr></table>
"""


def test_dining_pages(spark):  # noqa: ANN001, ANN201
    pages = spark.createDataFrame([(1, DINING), (2, None), (3, "<table><tr><td>점심</td></tr></table>")], "page_id long, html string")
    found = dining.cells(pages)
    assert {r["place"] for r in found.collect()} == {"North hall", "Price list", "South hall"}
    opening = [(r["meal"], r["weekday"], r["open"], r["close"], r["closed"]) for r in dining.hours(found).collect()]
    assert sorted(map(str, opening)) == sorted(map(str, [
        *(("lunch", d, "11:30", "14:00", False) for d in range(1, 6)), *(("dinner", d, "17:00", "18:30", False) for d in range(1, 6)),
        *(("lunch", d, None, None, True) for d in (0, 6, 7)),
    ]))
    assert [r["complete"] for r in dining.complete(dining.hours(found)).collect()] == [False]
    menu = {(r["date"].day, r["meal"], r["corner"]): (r["status"], r["items"], r["aligned"]) for r in dining.menus(found).collect()}
    assert menu == {
        (2, "lunch", "A"): ("operating", ["rice", "egg", "soup"], True), (3, "lunch", "A"): ("operating", ["noodles"], False), (4, "lunch", "A"): ("closed_temporary", [], True),
        **{(d, "lunch", "B"): ("operating", ["curry"], True) for d in (2, 3, 4)},
        (2, "dinner", ""): ("unknown", [], True), (3, "dinner", ""): ("operating", ["stew"], True), (4, "dinner", ""): ("operating", ["x"], True),
    }
    listed = sorted((r["name"], r["audience"], r["price_text"], r["price_min"], r["price_max"]) for r in dining.prices(found).collect())
    assert listed == [
        ("cutlet", "전체", "6,000원 - 6,500원", 6000, 6500), ("meal of the day", "구성원", "7,000원", 7000, 7000),
        ("meal of the day", "외부인", "8,500원", 8500, 8500), ("udon", "전체", "5,000원 부터", 5000, None),
    ]


def test_density_root_is_linear_and_innermost():  # noqa: ANN201
    page = "<body><div id=menu><a>" + "link " * 40 + "</a></div><div id=outer><p>x</p><div id=inner>" + "words of a text " * 30 + "</div></div><script>" + "s" * 5000 + "</script></body>"
    assert html.density_root(page).attrs["id"] == "inner"
    assert html.density_root("<div>" * 3000 + "text").tag == "div"
    assert html.density_root("plain").tag == "page"
