"""Queries on words at their borders, ranges and words of days, and on contents that are stored and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import dates, predicates, text
from lodestrata.plans._registry import query
from lodestrata.plans._tables import SECTIONS_SQL, page_sections
from lodestrata.session import scratch, table
from lodestrata.sources import files, links, sheets

#: Names end in a digit, a letter or a syllable with or without a final consonant.
ENDINGS = ("물", "차", "책", "")


@query(
    "fitting_particles",
    """
    WITH w AS (
        SELECT c_custkey, regexp_extract(c_name, '[0-9]$') AS digit, (ARRAY['물', '차', '책', ''])[c_custkey % 4 + 1] AS e, c_custkey % 3 = 0 AS quoted FROM customer
    ),
    f AS (SELECT *, CASE WHEN e <> '' THEN e IN ('물', '책') ELSE digit IN ('0', '1', '3', '6', '7', '8') END AS final FROM w)
    SELECT c_custkey, final, CASE WHEN final THEN '은' ELSE '는' END AS topic, CASE WHEN final AND e <> '물' THEN '으로' ELSE '로' END AS towards FROM f
    """,
)
def fitting_particles(spark, d):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    word = F.concat("c_name", F.get(F.array(*map(F.lit, ENDINGS)), (k % 4).cast("int")), F.when(k % 3 == 0, "』 ").otherwise(""))
    word = F.replace(word, F.lit("』"), F.lit('"'))
    return table(spark, d, "customer").select("c_custkey", text.has_final_consonant(word).alias("final"), text.particle(word, "은", "는").alias("topic"), text.particle(word, "으로", "로").alias("towards"))


@query(
    "date_ranges",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate::DATE END AS "start",
        CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE + (o_orderkey % 40)::INT WHEN 3 THEN o_orderdate::DATE END AS "end" FROM orders
    """,
)
def date_ranges(spark, d):  # noqa: ANN001, ANN201
    """Ranges, single dates of this and of a stated year, and ranges whose start is no date."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    last = F.date_add(day, (k % 40).cast("int"))
    shown = lambda date, form: F.date_format(date, form)
    written = (
        F.when(k % 4 == 0, F.concat(shown(day, "yyyy.MM.dd"), F.lit(" ~ "), shown(last, "yyyy-M-d")))
        .when(k % 4 == 1, shown(day, "yyyy/M/d")).when(k % 4 == 2, shown(day, "M/d")).otherwise(F.concat(F.lit("soon~"), shown(day, "yyyy-MM-dd")))
    )
    found = table(spark, d, "orders").select("o_orderkey", dates.date_range(written, F.year(day)).alias("r"))
    return found.select("o_orderkey", "r.start", "r.end")


@query(
    "named_days",
    """
    SELECT event_id, CASE event_id % 8 WHEN 6 THEN NULL WHEN 7 THEN ts::DATE - 1 ELSE ts::DATE + (event_id % 8 - 2)::INT END AS day FROM events
    """,
)
def named_days(spark, d):  # noqa: ANN001, ANN201
    """The day a message names by a word; of two words the first listed counts."""
    words = F.array(*map(F.lit, (*dates.RELATIVE_DAYS, "언제", "내일 말고 어제")))
    message = F.concat("event_type", F.lit(" "), F.get(words, (F.col("event_id") % 8).cast("int")), F.lit("에 뭐 있어"))
    return table(spark, d, "events").select("event_id", dates.relative_day(message, F.to_date("ts")).alias("day"))


@query(
    "label_remainders",
    """
    WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part),
    o AS (SELECT *, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) >= length(b) THEN b ELSE a END AS y FROM w)
    SELECT p_partkey, trim(regexp_replace(replace(replace('old ' || p_name || ' set', x, ''), y, ''), '\\s+', ' ', 'g')) AS remainder FROM o
    """,
)
def label_remainders(spark, d):  # noqa: ANN001, ANN201
    words = F.split("p_name", " ")
    label = F.concat(F.lit("old "), "p_name", F.lit(" set"))
    return table(spark, d, "part").select("p_partkey", text.without_words(label, F.array(F.element_at(words, 1), F.element_at(words, -1))).alias("remainder"))


@query(
    "word_borders",
    f"""
    WITH {SECTIONS_SQL}, s AS (SELECT page, ordinal, '가' || text || '나' AS t FROM sec)
    SELECT page, ordinal, regexp_matches(t, '(^|[^가-힣])the|the([^가-힣]|$)') AS stands, regexp_matches(t, '(^|[^가-힣])la') AS starts FROM s
    """,
)
def word_borders(spark, d):  # noqa: ANN001, ANN201
    """Whether needles stand at word borders, over all sections, each between two syllables."""
    shown = F.concat(F.lit("가"), "text", F.lit("나"))
    return page_sections(spark, d).select("page", "ordinal", text.wordwise_contains(shown, "the").alias("stands"), text.starts_word(shown, "la").alias("starts"))


@query("calendar_widgets", "SELECT o_orderkey, o_orderkey % 5 + 4 >= 7 AND o_orderkey % 3 <> 0 AS widget FROM orders")
def calendar_widgets(spark, d):  # noqa: ANN001, ANN201
    """Four to eight weekdays in a row from any day on, in a third of the texts interrupted after the third."""
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, predicates.WEEKDAYS * 3))
    week = F.slice(names, (k % 7 + 1).cast("int"), (k % 5 + 4).cast("int"))
    cut = F.when(k % 3 == 0, F.concat(F.slice(week, 1, 3), F.array(F.lit("x")), F.slice(week, F.lit(4), F.size(week)))).otherwise(week)
    shown = F.concat(F.lit("menu | "), F.array_join(cut, " | "), F.lit("\n1"))
    return table(spark, d, "orders").select("o_orderkey", predicates.calendar_widget(shown).alias("widget"))


@query("section_labels", f"WITH {SECTIONS_SQL} SELECT page, ordinal, 'a-' || trim(regexp_replace(nfc_normalize(text), '[\\s/#?%&:]+', '-', 'g'), ' ') || '-b' AS slug FROM (SELECT * REPLACE ('x/' || text || '#y' AS text) FROM sec)")
def section_labels(spark, d):  # noqa: ANN001, ANN201
    """Whole sections as parts of an address."""
    return page_sections(spark, d).select("page", "ordinal", F.concat(F.lit("a-"), text.slug(F.concat(F.lit("x/"), "text", F.lit("#y"))), F.lit("-b")).alias("slug"))


@query(
    "newest_snapshots",
    """
    WITH p AS (SELECT *, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)
    SELECT host AS source_key, max(page_id) AS page_id, sha256(arg_max(html, page_id)) AS content_hash FROM p GROUP BY 1
    """,
)
def newest_snapshots(spark, d):  # noqa: ANN001, ANN201
    """Contents stored by source, in two runs, and the newest of each source."""
    fetched = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    pages = table(spark, d, "pages").select(
        links.host_of(F.col("url")).alias("source_key"), "url", fetched.alias("fetched_at"), F.lit(200).alias("http_status"), F.lit("text/html").alias("media_type"), F.encode("html", "UTF-8").alias("content"),
    )
    path = scratch(spark, "snapshots")
    odd = F.unix_timestamp("fetched_at") % 2 == 1
    files.save_snapshots(pages.where(odd), path)
    files.save_snapshots(pages.where(~odd), path)
    newest = files.last_snapshots(files.load_snapshots(spark, path))
    return newest.select("source_key", (F.unix_timestamp("fetched_at") - 1_700_000_000).alias("page_id"), "content_hash")


@query(
    "sheet_posts",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS published_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'order, "' || o_orderstatus || '"' END AS title,
        CASE WHEN o_orderstatus = 'P' THEN 'no_title' WHEN o_orderkey % 7 = 0 THEN 'no_date' END AS reason FROM orders
    """,
)
def sheet_posts(spark, d):  # noqa: ANN001, ANN201
    """A sheet written with a byte order mark and read by its header names; rows without title or date are set apart, none is lost."""
    k = F.col("o_orderkey")
    title = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit('order, "'), "o_orderstatus", F.lit('"')))
    day = F.when(k % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy. M. d"))
    rows = table(spark, d, "orders").select(day.alias("published (day)"), title.alias("ti tle"), F.concat_ws("\n", F.lit("line"), k.cast("string")).alias("body"), k.alias("unused"), k.alias("no"))
    path = scratch(spark, "sheet")
    files.write_csv(rows, path)
    read = sheets.read_sheet(spark, path, {"published": "published_at", "title": "title", "body": "body", "no": "o_orderkey"}, ["published_at", "title"])
    good, bad = sheets.posts(read, 2024)
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "published_at", "title", "reason")
