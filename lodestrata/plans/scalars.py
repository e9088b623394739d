"""Queries on column functions: text, hashes, dates, prices, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import dates, hashes, predicates, text
from lodestrata.plans._registry import query
from lodestrata.session import table

FIRST = "string_split(text, chr(10))[1]"


def _first():  # noqa: ANN202
    return F.element_at(F.split("text", "\n"), 1)


@query("squeezed_titles", f"SELECT doc_id, trim(regexp_replace({FIRST}, '\\s+', ' ', 'g')) AS squeezed, regexp_replace({FIRST}, '\\s+', '', 'g') AS spaceless FROM documents")
def squeezed_titles(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", text.squeeze(_first()).alias("squeezed"), text.spaceless(_first()).alias("spaceless"))


@query("plain_names", "SELECT p_partkey, regexp_replace('(' || p_name || ') [' || p_brand || ']', '[\\s()\\[\\]{}<>]+', '', 'g') AS plain, lower(regexp_replace(p_name || '-' || p_brand, '[\\s[:punct:]]+', '', 'g')) AS bare FROM part")
def plain_names(spark, d):  # noqa: ANN001, ANN201
    named = F.concat(F.lit("("), "p_name", F.lit(") ["), "p_brand", F.lit("]"))
    return table(spark, d, "part").select("p_partkey", text.plain_name(named).alias("plain"), text.bare_name(F.concat_ws("-", "p_name", "p_brand")).alias("bare"))


@query("normalized_names", "SELECT p_partkey, regexp_replace(nfc_normalize(p_name), '\\s+', '', 'g') AS name FROM part")
def normalized_names(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select("p_partkey", text.normalized_name(F.col("p_name")).alias("name"))


@query("trigrams", "SELECT p_partkey, array_to_string(CASE WHEN length(p_name) < 3 THEN [] ELSE list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3)) END, ' ') AS grams FROM part")
def trigrams(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "part").select("p_partkey", F.array_join(text.grams(F.col("p_name")), " ").alias("grams"))


@query("longest_common_names")
def longest_common_names(spark, d):  # noqa: ANN001, ANN201
    """The longest common substring of each nation's and its region's name."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", text.longest_common(F.lower("n_name"), F.lower("r_name")).alias("common"))


@query("substring_places", "SELECT doc_id, instr(text, 'the') AS place, abs(instr(text, 'the') - instr(text, 'and')) AS spread FROM documents WHERE contains(text, 'the') AND contains(text, 'and')")
def substring_places(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "documents").where(F.contains("text", F.lit("the")) & F.contains("text", F.lit("and")))
    a, b = F.instr("text", "the").cast("long"), F.instr("text", "and").cast("long")
    return rows.select("doc_id", a.alias("place"), (F.greatest(a, b) - F.least(a, b)).alias("spread"))


@query("cell_items", "SELECT p_partkey, array_to_string(list_filter(list_transform(flatten(list_transform(string_split(p_name || chr(10) || p_brand || ' / ' || p_type, chr(10)), lambda l: string_split(l, '/'))), lambda x: trim(x)), lambda x: x <> ''), '+') AS items FROM part")
def cell_items(spark, d):  # noqa: ANN001, ANN201
    cell = F.concat("p_name", F.lit("\n"), "p_brand", F.lit(" / "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(text.cell_items(cell), "+").alias("items"))


@query("clipped", f"SELECT doc_id, CASE WHEN length({FIRST}) > 30 THEN substr({FIRST}, 1, 29) || '…' ELSE {FIRST} END AS clip FROM documents")
def clipped(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", text.clip(_first(), 30).alias("clip"))


@query("sentence_clip", "SELECT doc_id, CASE WHEN length(text) <= 700 THEN text WHEN regexp_extract(substr(text, 1, 700), '^((?s:.*)[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(substr(text, 1, 700), '^((?s:.*)[.!?])(?:\\s|$)', 1) ELSE substr(text, 1, 699) || '…' END AS clip FROM documents")
def sentence_clip(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", text.clip_at_sentence(F.col("text")).alias("clip"))


@query(
    "without_title",
    f"""
    WITH t AS (SELECT doc_id, text, array_to_string(string_split({FIRST}, ' ')[1:6], ' ') AS title FROM documents)
    SELECT doc_id, CASE WHEN regexp_replace(title, '[\\s[:punct:]]+', '', 'g') = '' THEN text ELSE regexp_replace(substr(text, length(title) + 1), '^[\\s[:punct:]]+', '') END AS rest FROM t
    """,
)
def without_title(spark, d):  # noqa: ANN001, ANN201
    """Texts without the first words of their first line, here written with a dash for each space."""
    title = F.substring_index(_first(), " ", 6)
    return table(spark, d, "documents").select("doc_id", text.without_leading_title(F.col("text"), F.replace(title, F.lit(" "), F.lit("-"))).alias("rest"))


@query("unescaped_titles", "SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS title FROM pages")
def unescaped_titles(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", text.unescaped(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query("content_hashes", "SELECT page_id, sha256(html) AS content_hash, sha256(regexp_replace(regexp_replace(html, '[?&](?:ver|v|_|ts|cb|rnd|nocache)=\\d+', '', 'g'), '(?i)jsessionid=[0-9A-F]+', '', 'g')) AS stable_hash FROM pages")
def content_hashes(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "pages").select("page_id", hashes.content_hash(F.col("html")).alias("content_hash"), hashes.stable_hash(F.col("html")).alias("stable_hash"))


@query("deterministic_keys", f"SELECT doc_id, substr(sha256(source || '|' || {FIRST} || '|0'), 1, 16) AS section_key, 'post-' || substr(sha256(lang || '|' || trim({FIRST})), 1, 16) AS post_key, 'doc/' || source || '/' || doc_id AS iri, source || '#' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS numbered, substr(sha256(regexp_replace({FIRST}, '\\s+', '', 'g')), 1, 16) AS fragment FROM documents")
def deterministic_keys(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select(
        "doc_id", hashes.section_key(F.col("source"), _first(), F.lit(0)).alias("section_key"), hashes.post_key(F.col("lang"), _first()).alias("post_key"),
        hashes.identifier("doc", F.col("source"), F.col("doc_id")).alias("iri"), hashes.numbered(F.col("source"), F.col("doc_id") % 100).alias("numbered"),
        hashes.fragment_hash(_first()).alias("fragment"),
    )


@query("staleness", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000.0, 4) AS hours, dayofweek(ts) AS weekday FROM events")
def staleness(spark, d):  # noqa: ANN001, ANN201
    hours = dates.hours_between(F.col("ts"), F.lit("2024-02-01 00:00:00"))
    return table(spark, d, "events").select("event_id", F.round(hours, 4).alias("hours"), dates.weekday_from_sunday(F.col("ts")).cast("long").alias("weekday"))


@query("flexible_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN make_date(2026, month(o_orderdate), least(day(o_orderdate), 28)) ELSE o_orderdate::DATE END AS day FROM orders")
def flexible_dates(spark, d):  # noqa: ANN001, ANN201
    o = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(o, "yyyy-M-d")).when(F.col("o_orderkey") % 4 == 1, F.date_format(o, "yyyy.MM.dd"))
    shown = shown.when(F.col("o_orderkey") % 4 == 2, F.concat_ws("/", F.month(o).cast("string"), F.least(F.day(o), F.lit(28)).cast("string"))).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", dates.flexible_date(shown, 2026).alias("day"))


@query("dates_in_text", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def dates_in_text(spark, d):  # noqa: ANN001, ANN201
    shown = F.concat(F.lit("posted "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(" by staff"))
    return table(spark, d, "orders").select("o_orderkey", dates.date_in(shown).alias("day"))


@query(
    "title_deadlines",
    """
    WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS p, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 4 AS k FROM orders),
    n AS (SELECT o_orderkey, p, CASE k WHEN 0 THEN make_date(year(p), 1, 5) WHEN 1 THEN make_date(year(p), m, d) WHEN 2 THEN make_date(year(p), 8, 9) END AS x FROM t)
    SELECT o_orderkey, CASE WHEN p - x > 180 THEN x + INTERVAL 1 YEAR ELSE x END::DATE AS deadline FROM n
    """,
)
def title_deadlines(spark, d):  # noqa: ANN001, ANN201
    """Titles in both forms, in both at once, and in none."""
    day = F.date_format("o_orderdate", "M/d")
    kind = F.pmod("o_orderkey", F.lit(4))
    title = F.when(kind == 0, F.lit("call (~1/5)")).when(kind == 1, F.concat(F.lit("open "), day, F.lit("(월) 까지"))).when(kind == 2, F.lit("8.9까지, then ~8/18")).otherwise(F.lit("no day"))
    return table(spark, d, "orders").select("o_orderkey", dates.title_deadline(title, F.to_date("o_orderdate")).alias("deadline"))


@query("day_labels", "SELECT o_orderkey, CASE WHEN coalesce(e, s) < DATE '1998-06-01' THEN 'past' WHEN s = DATE '1998-06-01' THEN 'today' WHEN s < DATE '1998-06-01' THEN 'running' WHEN s = DATE '1998-06-02' THEN 'tomorrow' ELSE 'D-' || (s - DATE '1998-06-01') END AS label FROM (SELECT o_orderkey, o_orderdate::DATE AS s, CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE + 30 END AS e FROM orders)")
def day_labels(spark, d):  # noqa: ANN001, ANN201
    s = F.to_date("o_orderdate")
    e = F.when(F.col("o_orderstatus") == "O", F.date_add(s, 30))
    return table(spark, d, "orders").select("o_orderkey", dates.day_label(s, e, F.lit("1998-06-01").cast("date")).alias("label"))


@query("period_texts", "SELECT o_orderkey, CASE WHEN year(s) = 1998 THEN month(s) || '/' || day(s) ELSE year(s) || '/' || month(s) || '/' || day(s) END || CASE WHEN e IS NULL THEN '' ELSE ' ~ ' || CASE WHEN year(e) = 1998 THEN month(e) || '/' || day(e) ELSE year(e) || '/' || month(e) || '/' || day(e) END END AS period FROM (SELECT o_orderkey, o_orderdate::DATE AS s, CASE WHEN o_orderstatus = 'O' THEN o_orderdate::DATE + 30 END AS e FROM orders)")
def period_texts(spark, d):  # noqa: ANN001, ANN201
    s = F.to_date("o_orderdate")
    e = F.when(F.col("o_orderstatus") == "O", F.date_add(s, 30))
    return table(spark, d, "orders").select("o_orderkey", dates.period_text(s, e, F.lit("1998-06-01").cast("date")).alias("period"))


@query("meal_of_hour", "SELECT CASE WHEN hour(ts) < 9 THEN 'breakfast' WHEN hour(ts) < 14 THEN 'lunch' ELSE 'dinner' END AS meal, count(*) AS n FROM events GROUP BY 1")
def meal_of_hour(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").groupBy(dates.meal_of_hour(F.col("ts")).alias("meal")).agg(F.count(F.lit(1)).alias("n"))


@query("asked_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN least(greatest(o_orderkey % 200, 1), 90) ELSE 14 END AS days FROM orders")
def asked_days(spark, d):  # noqa: ANN001, ANN201
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat((F.col("o_orderkey") % 200).cast("string"), F.lit("일"))).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", dates.asked_days(shown).cast("long").alias("days"))


@query("price_texts", "SELECT p_partkey, floor(p_retailprice)::INT AS price_min, CASE WHEN p_size % 2 = 0 THEN floor(p_retailprice)::INT + p_size END AS price_max FROM part")
def price_texts(spark, d):  # noqa: ANN001, ANN201
    from lodestrata.sources.sheets import price

    low = F.floor("p_retailprice").cast("int")
    shown = F.when(F.col("p_size") % 2 == 0, F.concat_ws("~", F.format_number(low, 0), F.format_number(low + F.col("p_size"), 0))).otherwise(F.concat(F.format_number(low, 0), F.lit("원부터")))
    parsed = price(shown)
    return table(spark, d, "part").select("p_partkey", parsed["min"].alias("price_min"), parsed["max"].alias("price_max"))


@query("json_property", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k') IS NOT NULL")
def json_property(spark, d):  # noqa: ANN001, ANN201
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k is not null")


@query("marker_and_topic", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(my|it)\\b') AND regexp_matches(text, '(?i)license|token')")
def marker_and_topic(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").where(predicates.marker_and_topic(F.col("text"), r"(?i)\b(my|it)\b", "(?i)license|token")).select("doc_id")


@query("first_category", "SELECT doc_id, CASE WHEN contains(t, 'idiot') OR contains(t, 'moron') THEN 'abuse' WHEN contains(t, 'licensed') OR contains(t, 'token=') THEN 'care' END AS category FROM (SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM documents)")
def first_category(spark, d):  # noqa: ANN001, ANN201
    found = predicates.first_category(F.lower("text"), {"abuse": ["idiot", "moron"], "care": ["licensed", "token ="]})
    return table(spark, d, "documents").select("doc_id", found.alias("category"))


@query("small_talk", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(regexp_replace(text, '[\\s.,!?~^;:()''\"-]+', '', 'g')), '^(hi|hello)$') THEN 'greeting' END AS kind FROM conversations")
def small_talk(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "conversations").select("conv_id", "turn", predicates.small_talk(F.col("text")).alias("kind"))


@query("week_start_agreement", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS week_start FROM orders")
def week_start_agreement(spark, d):  # noqa: ANN001, ANN201
    day = F.to_date("o_orderdate")
    second = F.when(F.col("o_orderkey") % 3 == 1, F.date_add(day, 7)).when(F.col("o_orderkey") % 3 == 0, day)
    third = F.when(F.col("o_orderkey") % 3 == 2, F.date_add(day, 1))
    return table(spark, d, "orders").select("o_orderkey", dates.agreed_week_start(day, second, third).alias("week_start"))
