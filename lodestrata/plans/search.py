"""Queries on search: the flagship, its parts, typed outcomes, batches of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import tokens as tokenise
from lodestrata.operators import search
from lodestrata.operators.search_index import build_index, open_index
from lodestrata.plans._registry import query
from lodestrata.plans._tables import SECTIONS_SQL, page_sections
from lodestrata.session import scratch, table

TOKENS = ["license", "thanedble", "anea"]


_built: dict[tuple, str] = {}


def _stored(spark, d):  # noqa: ANN001, ANN202
    """Where the index of a folder's documents is, built anew where their files are others than before."""
    files = table(spark, d, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, d, frozenset(map(tuple, files)))
    if key not in _built:
        _built[key] = scratch(spark, "search-index")
        build_index(sections(spark, d), _built[key])
    return _built[key]


def index(spark, d):  # noqa: ANN001, ANN201
    """The stored index of a folder's sections, built for its first question."""
    return open_index(spark, _stored(spark, d))


def sections(spark, d):  # noqa: ANN001, ANN201
    """Sections with the title (their page's first line), kind and address."""
    rows = page_sections(spark, d)
    return rows.withColumns(
        {
            "title": F.col("path"),
            "kind": F.when(F.contains("text", F.lit("|")), "table_row").otherwise("paragraph"),
            "url": F.concat_ws("/", F.lit("https:/"), "host", F.col("page").cast("string")),
        }
    )


INDEX_SQL = f"""
{SECTIONS_SQL},
ix AS (SELECT *, path AS title, CASE WHEN contains(text, '|') THEN 'table_row' ELSE 'paragraph' END AS kind FROM sec),
tk AS (SELECT unnest(['license', 'thanedble', 'anea']) AS t),
df AS (SELECT t, (SELECT count(*) FROM ix WHERE contains(lower(text), t)) AS n FROM tk),
wt AS (SELECT t, n, ln(((SELECT count(*) FROM ix) + 1) / greatest(n, 1)) * least(length(t) / 2, 2) AS w FROM df),
pb AS (SELECT t FROM df WHERE n <= (SELECT count(*) FROM ix) * 0.02 UNION ALL SELECT t FROM df WHERE NOT EXISTS (SELECT 1 FROM df WHERE n <= (SELECT count(*) FROM ix) * 0.02)),
ca AS (SELECT * FROM ix WHERE EXISTS (SELECT 1 FROM pb WHERE contains(lower(ix.text), pb.t) OR contains(lower(ix.path), pb.t))),
ht AS (SELECT ca.*, wt.t, wt.w, contains(ca.text, wt.t) AS here, contains(ca.path, wt.t) AS above, instr(ca.text, wt.t) AS place FROM ca JOIN wt ON contains(ca.text, wt.t) OR contains(ca.path, wt.t)),
sm AS (SELECT page, host, path, ordinal, text, title, kind, sum(w * CASE WHEN above THEN 1.6 ELSE 1.0 END) AS total, count(*) AS m, bool_and(above) AS all_above, bool_or(above) AS any_above,
    max(CASE WHEN here THEN place END) - min(CASE WHEN here THEN place END) AS spread, string_agg(t, ' ' ORDER BY t) AS matched, bool_or(contains(title, t)) AS titled FROM ht GROUP BY 1, 2, 3, 4, 5, 6, 7),
q AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM sm),
sc AS (SELECT *, total * (1 + 0.35 * (m - 1)) * CASE WHEN m > 1 AND all_above THEN 2.2 WHEN m > 1 AND coalesce(spread, 0) > 60 THEN 0.55 ELSE 1 END
    * CASE WHEN kind = 'table_row' AND NOT any_above THEN 0.35 ELSE 1 END
    * CASE WHEN s = '' OR regexp_matches(s, '^[\\d\\s.,\\-~/()%]+$') THEN 0.5 WHEN regexp_matches(s, '[^\\s:|][^\\n]*[:|]\\s*\\S') THEN 1 WHEN length(s) >= 12 AND len(string_split(s, ' ')) >= 3 THEN 1 ELSE 0.5 END AS raw FROM q)"""


@query(
    "search_topk",
    f"""
    WITH {INDEX_SQL}, f AS (SELECT *, round(raw, 3) AS score, round(CASE WHEN titled THEN raw * 2.4 ELSE raw END, 3) AS page_score FROM sc),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, length(text), ordinal) AS k, max(page_score) OVER (PARTITION BY page) AS best, count(*) OVER (PARTITION BY page) AS leaves FROM f),
    g AS (SELECT *, contains(title, 'license')::INT + contains(title, 'thanedble')::INT + contains(title, 'anea')::INT AS fit,
        length(title) - CASE WHEN contains(title, 'license') THEN 7 ELSE 0 END - CASE WHEN contains(title, 'thanedble') THEN 9 ELSE 0 END - CASE WHEN contains(title, 'anea') THEN 4 ELSE 0 END AS surplus FROM r WHERE k = 1)
    SELECT page, host, ordinal, score, best AS page_score, leaves FROM g ORDER BY best DESC, fit DESC, surplus, leaves DESC, length(text), page LIMIT 5
    """,
)
def search_topk(spark, d):  # noqa: ANN001, ANN201
    found = search.search(index(spark, d), TOKENS)
    return found.where(F.col("place") <= 5).select("page", "host", "ordinal", "score", F.col("best_page_score").alias("page_score"), "leaves")


@query("search_index", f"WITH {SECTIONS_SQL} SELECT host, count(*) AS sections, sum(length(text)) AS chars FROM sec GROUP BY host")
def search_index(spark, d):  # noqa: ANN001, ANN201
    """The stored index by its hosts; the first question over a folder builds it."""
    return index(spark, d).hosts


@query("section_scores", f"WITH {INDEX_SQL} SELECT page, ordinal, matched, round(raw, 3) AS score FROM sc")
def section_scores(spark, d):  # noqa: ANN001, ANN201
    rows = index(spark, d)
    total, df, weights = search.token_weights(rows, TOKENS)
    candidates = rows.holding(search.probes(total, df))
    return search.score_sections(candidates, TOKENS, weights).select("page", "ordinal", F.array_join(F.sort_array("matched"), " ").alias("matched"), "score")


@query("candidate_count", f"WITH {INDEX_SQL} SELECT count(*) AS matched, least(count(*), 600) AS returned, count(*) > 600 AS truncated FROM ca")
def candidate_count(spark, d):  # noqa: ANN001, ANN201
    rows = index(spark, d)
    total, df, _ = search.token_weights(rows, TOKENS)
    hits = rows.holding(search.probes(total, df))
    return hits.agg(F.count(F.lit(1)).alias("matched"), F.least(F.count(F.lit(1)), F.lit(600)).alias("returned"), (F.count(F.lit(1)) > 600).alias("truncated"))


@query("token_weights", f"WITH {INDEX_SQL} SELECT t AS token, n AS df, round(w, 6) AS weight FROM wt")
def token_weights(spark, d):  # noqa: ANN001, ANN201
    _, df, weights = search.token_weights(index(spark, d), TOKENS)
    return spark.createDataFrame([(t, df[t], round(weights[t], 6)) for t in TOKENS], "token string, df long, weight double")


@query(
    "bm25_topk",
    f"""
    WITH {INDEX_SQL}, x AS (SELECT page, ordinal, text, length(text) AS l, len(string_split(lower(text), 'license')) - 1 AS a, len(string_split(lower(text), 'anea')) - 1 AS b FROM ix),
    s AS (SELECT count(*) AS n, avg(l) AS al, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM x)
    SELECT page, ordinal, round(greatest(1e-6, ln((n - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / al)) + greatest(1e-6, ln((n - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / al)), 4) AS bm25
    FROM x, s WHERE a > 0 OR b > 0 ORDER BY bm25 DESC, page, ordinal LIMIT 20
    """,
)
def bm25_topk(spark, d):  # noqa: ANN001, ANN201
    words = ["license", "anea"]
    found = search.bm25(index(spark, d), words)
    return found.select("page", "ordinal", F.round("bm25", 4).alias("bm25")).orderBy(F.desc("bm25"), "page", "ordinal").limit(20)


@query("truncation_report", "WITH m AS (SELECT * FROM orders WHERE o_totalprice > 350000) SELECT o_orderkey, least((SELECT count(*) FROM m), 10) AS returned, 10 AS \"limit\", (SELECT count(*) FROM m) > 10 AS truncated, CASE WHEN (SELECT count(*) FROM m) > 10 THEN (SELECT count(*) FROM m) END AS matched FROM m ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def truncation_report(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "orders").where("o_totalprice > 350000").select("o_orderkey", "o_totalprice")
    return search.truncation(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 10).drop("o_totalprice")


@query(
    "batch_questions",
    f"""
    WITH {SECTIONS_SQL}, w AS (SELECT DISTINCT page, ordinal, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}+]+')) AS token FROM sec),
    q AS (SELECT * FROM (VALUES ('a', 'license'), ('a', 'anea'), ('b', 'idiot'), ('b', 'and'), ('c', 'thanedble')) v(question, token)),
    d AS (SELECT token, count(*) AS df FROM w WHERE token IN (SELECT token FROM q) GROUP BY 1),
    h AS (SELECT q.question, w.page, w.ordinal, ln(((SELECT count(*) FROM sec) + 1.0) / d.df) * least(length(token) / 2, 2.0) AS x FROM w JOIN d USING (token) JOIN q USING (token))
    SELECT question, page, ordinal, count(*) AS m, round(sum(x) * (1 + 0.35 * (count(*) - 1)), 3) AS score FROM h GROUP BY 1, 2, 3
    """,
)
def batch_questions(spark, d):  # noqa: ANN001, ANN201
    asked = spark.createDataFrame([("a", ["license", "anea"]), ("b", ["Idiot", "and"]), ("c", ["thanedble"])], "question string, tokens array<string>")
    return search.batch_scores(index(spark, d), asked)


@query(
    "question_tokens",
    """
    WITH w AS (
        SELECT doc_id, list_transform(string_split_regex(coalesce(string_split(text, chr(10))[1], ''), '[^0-9A-Za-z가-힣+]+'),
            lambda w: CASE WHEN regexp_full_match(w, '\\+*[0-9]+\\+*') THEN replace(w, '+', '') ELSE w END) AS l FROM documents
    ),
    k AS (SELECT doc_id, list_filter(l, lambda w: w NOT IN ('The', 'the') AND (length(w) >= 2 OR regexp_full_match(w, '[A-Za-z][+-]'))) AS l FROM w)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ' ') AS tokens FROM k
    """,
)
def question_tokens(spark, d):  # noqa: ANN001, ANN201
    """First lines as questions; none of them holds an ending that is taken off."""
    first = F.element_at(F.split("text", "\n"), 1)
    return table(spark, d, "documents").select("doc_id", F.array_join(tokenise(first, ["The", "the"]), " ").alias("tokens"))


@query("heaviest_token", f"WITH {SECTIONS_SQL}, w AS (SELECT DISTINCT page, ordinal, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}+]+')) AS token FROM sec), d AS (SELECT token, count(*) AS df FROM w WHERE length(token) >= 2 GROUP BY 1), t AS (SELECT DISTINCT page, unnest(string_split_regex(lower(path), '[^\\p{{L}}\\p{{N}}+]+')) AS token FROM sec), x AS (SELECT page, token, round(ln(((SELECT count(*) FROM sec) + 1.0) / df) * least(length(token) / 2, 2.0), 6) AS v FROM t JOIN d USING (token)) SELECT page, token AS shortened FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY v DESC, token) AS k FROM x) WHERE k = 1")
def heaviest_token(spark, d):  # noqa: ANN001, ANN201
    rows = page_sections(spark, d)
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}+]+"))).alias("token")
    df = rows.select(words("text")).where(F.char_length("token") >= 2).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = rows.count()
    v = F.round(F.log(F.lit(total + 1.0) / F.col("df")) * F.least(F.char_length("token") / 2, F.lit(2.0)), 6)
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("page"), words(F.element_at(F.split("text", "\n"), 1)))
    scored = titles.join(df, "token").select("page", "token", v.alias("v"))
    return scored.groupBy("page").agg(F.min_by("token", F.struct(-F.col("v"), F.col("token"))).alias("shortened"))


@query("clarify_options", f"WITH {SECTIONS_SQL}, b AS (SELECT page, ordinal, text AS title FROM sec WHERE contains(lower(text), 'the')), p AS (SELECT page, ordinal, title, list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: length(x) >= 2) AS l FROM b), o AS (SELECT page, ordinal, unnest(CASE WHEN len(l) >= 2 THEN l ELSE [trim(title)] END) AS option FROM p) SELECT page, n FROM (SELECT page, count(DISTINCT lower(regexp_replace(option, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) AS n FROM o GROUP BY 1) WHERE n BETWEEN 2 AND 10")
def clarify_options(spark, d):  # noqa: ANN001, ANN201
    blocks = page_sections(spark, d).withColumn("title", F.col("text"))
    return search.clarify_options(blocks, ["the"]).select("page", F.size("options").cast("long").alias("n"))


@query("review_suspects", "SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'License') EXCEPT SELECT doc_id FROM documents WHERE contains(lower(string_split(text, chr(10))[1]), 'license')")
def review_suspects(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents")
    hit = F.contains("text", F.lit("license")) | F.contains("text", F.lit("License"))
    return docs.where(hit & ~F.contains(F.lower(F.element_at(F.split("text", "\n"), 1)), F.lit("license"))).select("doc_id")


@query("notice_search", "SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00') AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer) ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 5")
def notice_search(spark, d):  # noqa: ANN001, ANN201
    customers = table(spark, d, "customer")
    host = customers.agg(F.min("c_mktsegment")).first()[0]
    found = customers.where(F.contains("c_name", F.lit("00")) & (F.col("c_mktsegment") == host))
    return found.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").select("c_custkey", "c_name").limit(5)
