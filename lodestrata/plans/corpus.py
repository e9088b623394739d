"""Queries on corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import corpus
from lodestrata.plans._registry import query
from lodestrata.plans._tables import SECTIONS_SQL, page_sections
from lodestrata.session import table


@query("vocabulary_df", f"WITH {SECTIONS_SQL}, w AS (SELECT page, ordinal, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM sec) SELECT term, count(*) AS df FROM w WHERE length(term) BETWEEN 2 AND 20 GROUP BY 1 HAVING count(*) >= 3")
def vocabulary_df(spark, d):  # noqa: ANN001, ANN201
    return corpus.vocabulary(page_sections(spark, d), "text")


@query("token_doc_freq", f"WITH {SECTIONS_SQL} SELECT t AS token, (SELECT count(*) FROM sec WHERE contains(lower(text), t)) AS df FROM (SELECT unnest(['anea', 'license', 'the', 'idiot']) AS t)")
def token_doc_freq(spark, d):  # noqa: ANN001, ANN201
    return corpus.document_frequency(page_sections(spark, d), "text", ["anea", "license", "the", "idiot"])


FRAGMENTS_SQL = f"""
{SECTIONS_SQL},
fr AS (SELECT host AS profile, page, substr(sha256(regexp_replace(text, '\\s+', '', 'g')), 1, 16) AS digest, min(text) AS text FROM sec WHERE length(trim(text)) >= 6 GROUP BY 1, 2, 3),
tot AS (SELECT profile, count(DISTINCT page) AS total FROM fr GROUP BY 1),
cnt AS (SELECT profile, digest, count(*) AS pages, min(text) AS text FROM fr GROUP BY 1, 2),
bp AS (SELECT profile, digest, pages, total, CASE WHEN pages >= greatest(3, floor(total * 0.06)::INT) THEN 'boilerplate' WHEN pages >= greatest(3, floor(total * 0.06)::INT) * 0.5 THEN 'borderline' END AS kind, text
    FROM cnt JOIN tot USING (profile) WHERE total >= 3)"""


def _fragments(spark, d):  # noqa: ANN001, ANN202
    return corpus.fragments(page_sections(spark, d), "host", "page", "text")


@query("boilerplate_lines", f"WITH {FRAGMENTS_SQL} SELECT profile, digest, pages, total, kind, text FROM bp WHERE kind IS NOT NULL")
def boilerplate_lines(spark, d):  # noqa: ANN001, ANN201
    return corpus.boilerplate(_fragments(spark, d), 0.06, 3)


@query(
    "boilerplate_pruned",
    f"""
    WITH {FRAGMENTS_SQL}, m AS (SELECT fr.*, coalesce(bp.kind = 'boilerplate', false) AS marked FROM fr LEFT JOIN bp USING (profile, digest)),
    s AS (SELECT profile, page, sum(CASE WHEN marked THEN length(text) ELSE 0 END) / sum(length(text)) AS share FROM m GROUP BY 1, 2)
    SELECT page, count(*) AS fragments, bool_or(share > 0.8) AS held FROM m JOIN s USING (profile, page) WHERE NOT marked OR share > 0.8 GROUP BY 1
    """,
)
def boilerplate_pruned(spark, d):  # noqa: ANN001, ANN201
    found = _fragments(spark, d)
    return corpus.prune(found, corpus.boilerplate(found, 0.06, 3)).groupBy("page").agg(F.count(F.lit(1)).alias("fragments"), F.bool_or("held").alias("held"))


PROFILE_SQL = """
w AS (SELECT source AS title, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents),
c AS (SELECT title, word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY 1, 2),
k AS (SELECT title, word, row_number() OVER (PARTITION BY title ORDER BY n DESC, word) AS i FROM c),
pr AS (SELECT title, word FROM k WHERE i <= 40)"""


@query("content_profile", f"WITH {PROFILE_SQL} SELECT title, string_agg(word, ' ' ORDER BY word) AS words FROM pr GROUP BY 1")
def content_profile(spark, d):  # noqa: ANN001, ANN201
    found = corpus.content_profile(table(spark, d, "documents"), "source", "text")
    return found.select("title", F.array_join("words", " ").alias("words"))


@query("content_overlap_pairs", f"WITH {PROFILE_SQL}, n AS (SELECT title, count(*) AS n FROM pr GROUP BY 1) SELECT a.title AS a, b.title AS b, count(*) AS shared, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) AS overlap FROM pr a JOIN pr b ON a.word = b.word AND a.title < b.title JOIN n x ON x.title = a.title JOIN n y ON y.title = b.title GROUP BY 1, 2 HAVING count(*) / least(any_value(x.n), any_value(y.n)) >= 0.25")
def content_overlap_pairs(spark, d):  # noqa: ANN001, ANN201
    return corpus.overlapping_pairs(corpus.content_profile(table(spark, d, "documents"), "source", "text"), "title", "words", 0.25)


@query(
    "title_synonyms",
    """
    WITH d AS (SELECT lower(split_part(text, ' ', 1)) AS title, source AS host, text FROM documents),
    h AS (SELECT DISTINCT title, host FROM d WHERE trim(title) <> ''),
    t AS (SELECT title, count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 3),
    w AS (SELECT title, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM d JOIN t USING (title)),
    k AS (SELECT title, word, row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, word) AS k FROM w WHERE length(word) >= 2 GROUP BY 1, 2),
    pr AS (SELECT title, list_sort(list(word)) AS words FROM k WHERE k <= 40 GROUP BY 1),
    p AS (SELECT a.title AS a, b.title AS b, round(len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)), 6) AS overlap FROM pr a JOIN pr b ON a.title < b.title),
    g AS (SELECT title, regexp_replace(title, '[\\s()\\[\\]{}<>]+', '', 'g') AS s FROM t),
    r AS (SELECT title, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS two FROM g),
    c AS (SELECT DISTINCT x.title AS a, y.title AS b FROM r x JOIN r y ON x.two = y.two AND x.title < y.title),
    o AS (SELECT x.title AS a, y.title AS b, count(*) AS n FROM h x JOIN h y ON x.host = y.host AND x.title < y.title GROUP BY 1, 2)
    SELECT p.a, p.b, p.overlap, ta.n AS sites_a, tb.n AS sites_b, round(coalesce(o.n, 0) / least(ta.n, tb.n), 6) AS host_overlap
    FROM p JOIN c ON c.a = p.a AND c.b = p.b JOIN t ta ON ta.title = p.a JOIN t tb ON tb.title = p.b LEFT JOIN o ON o.a = p.a AND o.b = p.b
    WHERE p.overlap >= 0.25 AND coalesce(o.n, 0) / least(ta.n, tb.n) <= 0.1
    """,
)
def title_synonyms(spark, d):  # noqa: ANN001, ANN201
    """The first words of documents as titles, their sources as sites."""
    found = corpus.title_synonyms(_titled(spark, d))
    return found.select("a", "b", "overlap", "sites_a", "sites_b", "host_overlap")


def _titled(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "documents").select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("title"), F.col("source").alias("host"), "text")


@query("synonym_groups")
def synonym_groups(spark, d):  # noqa: ANN001, ANN201
    """Groups of titles that name the same thing, every pair observed; the widest title is the label."""
    rows = _titled(spark, d)
    sites = rows.groupBy(F.col("title").alias("name")).agg(F.count_distinct("host").alias("weight"))
    return corpus.cliques(corpus.title_synonyms(rows), sites)


@query("term_occurrences", f"WITH {SECTIONS_SQL} SELECT count(*) AS sections, count(DISTINCT page) AS pages, count(DISTINCT host) AS hosts FROM sec WHERE contains(lower(text), 'license')")
def term_occurrences(spark, d):  # noqa: ANN001, ANN201
    return corpus.term_occurrences(page_sections(spark, d), "License", "text", "page", "host")


@query("term_shift", f"WITH {SECTIONS_SQL}, c AS (SELECT page, count(*) FILTER (WHERE contains(lower(text), 'thing')) AS old, count(*) FILTER (WHERE contains(lower(text), 'ention')) AS new, count(*) FILTER (WHERE contains(lower(text), 'thing') AND contains(lower(text), 'ention')) AS \"both\" FROM sec GROUP BY 1) SELECT page, old, new, \"both\", old > 0 AND new = 0 AS only_old FROM c WHERE old > 0 OR new > 0")
def term_shift(spark, d):  # noqa: ANN001, ANN201
    return corpus.term_shift(page_sections(spark, d), "thing", "ention", "text", "page")


@query("classify_argmax", "SELECT doc_id, CASE WHEN en = 0 AND fr = 0 AND de = 0 THEN NULL WHEN en >= fr AND en >= de THEN 'en' WHEN fr >= de THEN 'fr' ELSE 'de' END AS domain FROM (SELECT doc_id, (contains(text, ' the '))::INT + (contains(text, ' of '))::INT AS en, (contains(text, ' le '))::INT + (contains(text, ' des '))::INT AS fr, (contains(text, ' der '))::INT + (contains(text, ' und '))::INT AS de FROM documents)")
def classify_argmax(spark, d):  # noqa: ANN001, ANN201
    domains = {"en": [" the ", " of "], "fr": [" le ", " des "], "de": [" der ", " und "]}
    return table(spark, d, "documents").select("doc_id", corpus.classify_domain(F.col("text"), domains).alias("domain"))


@query("document_kinds", "SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '\\d{4}[-./]\\d{1,2}[-./]\\d{1,2}')) AS dated, count(*) FILTER (WHERE contains(text, '|')) AS bars, count(*) FILTER (WHERE regexp_matches(text, '(?i)copyright|licensed|©')) AS legal, count(*) FILTER (WHERE length(text) < 40) AS short FROM documents GROUP BY 1")
def document_kinds(spark, d):  # noqa: ANN001, ANN201
    flagged = table(spark, d, "documents").select("lang", *corpus.document_kinds(F.col("text")))
    return flagged.groupBy("lang").agg(F.count_if("dated").alias("dated"), F.count_if("table").alias("bars"), F.count_if("legal").alias("legal"), F.count_if("short").alias("short"))


@query("alias_traps", "SELECT source, sum(len(regexp_extract_all(text, '[A-Za-z]the|the[A-Za-z]')))::BIGINT AS inside FROM documents GROUP BY 1")
def alias_traps(spark, d):  # noqa: ANN001, ANN201
    inside = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]the|the[A-Za-z]"), F.lit(0)))
    return table(spark, d, "documents").groupBy("source").agg(F.sum(inside).alias("inside"))


@query("markup_census", "SELECT CASE WHEN contains(html, '<article') THEN 'article' WHEN contains(html, '<main') THEN 'main' ELSE 'other' END AS container, count(*) AS n, round(avg(length(html)), 2) AS avg_chars FROM pages GROUP BY 1")
def markup_census(spark, d):  # noqa: ANN001, ANN201
    kind = F.when(F.contains("html", F.lit("<article")), "article").when(F.contains("html", F.lit("<main")), "main").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("container")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.char_length("html")), 2).alias("avg_chars"))


@query("page_split", f"WITH {SECTIONS_SQL}, c AS (SELECT page, count(*) FILTER (WHERE contains(text, 'the')) AS hits FROM sec GROUP BY 1) SELECT CASE WHEN hits = 0 THEN 'none' WHEN hits = 1 THEN 'one' ELSE 'many' END AS split, count(*) AS pages FROM c GROUP BY 1")
def page_split(spark, d):  # noqa: ANN001, ANN201
    hits = page_sections(spark, d).groupBy("page").agg(F.count_if(F.contains("text", F.lit("the"))).alias("hits"))
    split = F.when(F.col("hits") == 0, "none").when(F.col("hits") == 1, "one").otherwise("many")
    return hits.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("pages"))


@query("segment_words")
def segment_words(spark, d):  # noqa: ANN001, ANN201
    """Long words of the documents cut into vocabulary words, where that can be done."""
    known = corpus.vocabulary(page_sections(spark, d), "text")
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    words = table(spark, d, "documents").select(word).distinct()
    return corpus.segmented(words, known).select("word", F.array_join("pieces", "+").alias("pieces"))
