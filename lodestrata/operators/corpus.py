"""Statistics of a corpus: vocabulary, boilerplate, overlap of titles, terms, segmentation."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored

LEAST_PAGES, SHARE, BORDERLINE, HELD = 5, 0.25, 0.5, 0.8
#: Titles of one run of characters that meet all others of it in one deal, and the least number of partitions for such meetings.
MET, LEAST_PARTS = 256, 64


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Documents as sections: page (the id), ordinal, host, path (the first line), text (the line)."""
    lines = F.split(F.col(text_col), "\n")
    return docs.select(
        F.col(id_col).alias("page"), F.col(host_col).alias("host"), F.element_at(lines, 1).alias("path"), F.posexplode(lines).alias("ordinal", "text")
    )


def vocabulary(texts: DataFrame, text: str, shortest: int = 2, longest: int = 20, least: int = 3) -> DataFrame:
    """Words and in how many texts each occurs, if in at least so many."""
    words = F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("term")
    found = texts.select(words).where(F.char_length("term").between(shortest, longest))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def document_frequency(texts: DataFrame, text: str, words: list[str]) -> DataFrame:
    """In how many texts each of a few words stands, in one pass."""
    counted = texts.agg(*(F.count_if(F.contains(F.lower(text), F.lit(w.lower()))).alias(f"w{i}") for i, w in enumerate(words)))
    pairs = F.explode(F.array(*(F.struct(F.lit(w).alias("token"), F.col(f"w{i}").alias("df")) for i, w in enumerate(words)))).alias("p")
    return counted.select(pairs).select("p.*")


def fragments(rows: DataFrame, profile: str, page: str, text: str, least_chars: int = 6) -> DataFrame:
    """Each page's different fragments: profile, page, digest and text of those long enough."""
    bare = F.regexp_replace(text, r"\s+", "")
    digest = F.substring(F.sha2(bare, 256), 1, 16)
    kept = rows.where(F.char_length(F.trim(text)) >= least_chars)
    return kept.groupBy(F.col(profile).alias("profile"), F.col(page).alias("page"), digest.alias("digest")).agg(F.min(text).alias("text"))


def boilerplate(found: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Fragments that stand on many pages of their profile: boilerplate, and borderline from half
    the threshold.  Profiles of fewer pages abstain."""
    totals = found.groupBy("profile").agg(F.count_distinct("page").alias("total"))
    counts = found.groupBy("profile", "digest").agg(F.count(F.lit(1)).alias("pages"), F.min("text").alias("text"))
    return judge(counts, totals, share, least_pages)


def judge(counts: DataFrame, totals: DataFrame, share: float, least_pages: int) -> DataFrame:
    """The same from ``counts`` (profile, digest, pages, text) and ``totals`` (profile, total)."""
    need = F.greatest(F.lit(least_pages), F.floor(F.col("total") * share).cast("int"))
    kind = F.when(F.col("pages") >= need, "boilerplate").when(F.col("pages") >= need * BORDERLINE, "borderline")
    judged = counts.join(totals, "profile").where(F.col("total") >= least_pages)
    return judged.withColumn("kind", kind).where("kind is not null").select("profile", "digest", "pages", "total", "kind", "text")


def prune(found: DataFrame, judged: DataFrame, held: float = HELD) -> DataFrame:
    """Fragments of pages without boilerplate; a page that would lose over ``held`` of its characters
    keeps them all."""
    marks = judged.where("kind = 'boilerplate'").select("profile", "digest", F.lit(True).alias("marked"))
    both = found.join(marks, ["profile", "digest"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    chars = F.char_length("text")
    shares = both.groupBy("profile", "page").agg((F.sum(F.when(F.col("marked"), chars).otherwise(0)) / F.sum(chars)).alias("share"))
    return both.join(shares, ["profile", "page"]).withColumn("held", F.col("share") > held).where(~F.col("marked") | F.col("held"))


def content_profile(texts: DataFrame, title: str, text: str, top: int = 40, pattern: str = r"[^\p{L}\p{N}]+") -> DataFrame:
    """Each title's most frequent words: sorted array ``words``; ties by the word."""
    word = F.explode(F.split(F.lower(text), pattern)).alias("word")
    counts = texts.select(F.col(title).alias("title"), word).where(F.char_length("word") >= 2).groupBy("title", "word").count()
    w = Window.partitionBy("title").orderBy(F.desc("count"), "word")
    best = counts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)
    return best.groupBy("title").agg(F.sort_array(F.collect_list("word")).alias("words"))


def overlap(a: Column, b: Column) -> Column:
    """Shared entries over the size of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def overlapping_pairs(profiles: DataFrame, key: str, words: str, least: float) -> DataFrame:
    """Pairs a < b of sets whose overlap reaches ``least``, by the words they share.

    Of a pair that reaches it, the smaller set has a shared word among its rarest, as the share of
    words that it can miss is bounded.  So the smaller sets are met under their rarest words alone,
    and words that nearly all sets have draw no pairs.
    """
    flat = profiles.select(F.col(key).alias("k"), F.size(words).alias("n"), F.explode(words).alias("w"))
    flat = flat.join(flat.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w")
    rarest = F.row_number().over(Window.partitionBy("k").orderBy("df", "w")) <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1
    small = flat.withColumn("rare", rarest).where("rare").select("w", F.col("k").alias("s"), F.col("n").alias("ns"))
    met = small.join(flat.select("w", F.col("k").alias("t"), F.col("n").alias("nt")), "w").where("ns < nt or (ns = nt and s < t)")
    pairs = met.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    side = lambda name: profiles.select(F.col(key).alias(name), F.col(words).alias(f"{name}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_words", "b_words")).cast("long")
    share = F.round(shared / F.least(F.size("a_words"), F.size("b_words")), 6)
    return both.select("a", "b", shared.alias("shared"), share.alias("overlap")).where(F.col("overlap") >= least)


def title_synonyms(
    sections: DataFrame, sites: int = 3, common: int = 2, site_share: float = 0.1, least: float = 0.25, words: str = r"[^\p{L}\p{N}]+"
) -> DataFrame:
    """Pairs a < b of titles that name the same thing: sections (title, host, text).

    Each stands on at least ``sites`` sites; their plain forms share a run of at least ``common``
    characters; of the sites of the one on fewer, at most ``site_share`` have the other too; and
    the contents written under them overlap.
    """
    from lodestrata.functions.text import longest_common, plain_name

    titled = sections.where(F.trim(F.coalesce("title", F.lit(""))) != "")
    wide = titled.groupBy("title").agg(F.collect_set("host").alias("hosts")).where(F.size("hosts") >= sites)
    wide = stored(wide, "titles")
    profiles = stored(content_profile(titled.join(wide.select("title"), "title", "left_semi"), "title", "text", pattern=words), "profiles")
    # Words become numbers; those of one title alone can't be shared.
    each = profiles.select("title", F.explode("words").alias("word"))
    shared = each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = stored(shared.select("word", F.monotonically_increasing_id().alias("id")), "words")
    ids = each.join(shared, "word").groupBy("title").agg(F.collect_list("id").alias("ids"))
    plain = plain_name(F.col("title"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("plain") - max(common, 1) + 1), lambda i: F.substring(F.col("plain"), i, F.lit(max(common, 1)))))
    known = wide.join(profiles.select("title", F.size("words").alias("n_words")), "title").join(ids, "title").withColumn("plain", plain)
    known = known.where(F.char_length("plain") >= common).withColumn("grams", grams if common > 0 else F.array(F.lit("")))
    rows = stored(known.select("title", "hosts", "grams", "ids", "n_words"), "titles").withColumn("gram", F.explode("grams"))
    # Titles that share a run of characters meet under the least of these runs; one that many hold is dealt to several tasks.
    held = rows.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("deals")).where("gram is not null")
    dealt = rows.join(held, "gram")
    parts = max(LEAST_PARTS, int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    side = lambda frame, name, deal: frame.select("gram", deal.alias("deal"), *(F.col(c).alias(f"{name}_{c}") for c in ("title", "hosts", "grams", "ids", "n_words"))).repartition(parts, "gram", "deal")
    left = side(dealt, "a", F.pmod(F.xxhash64("title"), F.col("deals")).cast("int"))
    right = side(dealt, "b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    host_share = F.size(F.array_intersect("a_hosts", "b_hosts")) / F.least(F.size("a_hosts"), F.size("b_hosts"))
    overlap = F.round(F.size(F.array_intersect("a_ids", "b_ids")) / F.least("a_n_words", "b_n_words"), 6)
    met = left.join(right, ["gram", "deal"]).where(
        (F.col("a_title") < F.col("b_title")) & (host_share <= site_share) & (F.array_min(F.array_intersect("a_grams", "b_grams")) == F.col("gram")) & (overlap >= least)
    )
    found = met.select(
        F.col("a_title").alias("a"), F.col("b_title").alias("b"), F.size("a_hosts").cast("long").alias("sites_a"), F.size("b_hosts").cast("long").alias("sites_b"),
        F.round(host_share, 6).alias("host_overlap"), overlap.alias("overlap"),
    )
    run = longest_common(plain_name(F.col("a")), plain_name(F.col("b")))
    return found.withColumn("common", run).select("a", "b", "common", "sites_a", "sites_b", "host_overlap", "overlap")


def connected(pairs: DataFrame) -> DataFrame:
    """Every name of the pairs (a, b) with the smallest name that it is connected to."""
    edges = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "connected")
    labels = stored(edges.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("name")).alias("least")), "connected")
    while True:
        near = edges.join(labels.select(F.col("name").alias("b"), "least"), "b").groupBy(F.col("a").alias("name")).agg(F.min("least").alias("near"))
        # The label of the label, too, so that long paths halve.
        jump = labels.select(F.col("name").alias("least"), F.col("least").alias("further"))
        moved = labels.join(near, "name").join(jump, "least", "left")
        moved = stored(moved.select("name", F.least("least", "near", "further").alias("least"), F.col("least").alias("before")), "connected")
        labels = moved.select("name", "least")
        if moved.where("least <> before").isEmpty():
            return labels


def cliques(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Groups (label, member) in which every two members are a pair (a, b): a chain of pairs is no group.

    Names are taken by ``weights`` (name, weight), the heaviest first, and join the first group that
    they fit, so what is connected is grouped by itself, one component a call.
    """
    pairs = stored(pairs.select("a", "b"), "pairs")
    weighted = weights.select(F.col("name").alias("a"), "weight")
    rows = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rows = rows.join(weighted, "a").join(connected(pairs).withColumnRenamed("name", "a"), "a")

    def grouped(found: pd.DataFrame) -> pd.DataFrame:
        near = found.groupby("a")["b"].agg(set)
        names = found.drop_duplicates("a").sort_values(["weight", "a"], ascending=[False, True])["a"]
        groups: list[list[str]] = []
        place: dict[str, int] = {}
        for name in names:
            # Only groups of neighbours can fit, and one fits if all its members are neighbours.
            met = Counter(place[b] for b in near[name] if b in place)
            at = min((g for g, n in met.items() if n == len(groups[g])), default=None)
            if at is None:
                at = len(groups)
                groups.append([])
            groups[at].append(name)
            place[name] = at
        made = [(g[0], member) for g in groups if len(g) > 1 for member in g]
        return pd.DataFrame(made, columns=["label", "member"])

    return rows.groupBy("least").applyInPandas(grouped, "label string, member string")


def classify_domain(text: Column, domains: dict[str, list[str]]) -> Column:
    """The domain with most keyword hits, the first listed of equal ones; null without any hit."""
    scored = [
        F.struct(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name"))
        for i, (name, words) in enumerate(domains.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"])


def term_occurrences(rows: DataFrame, term: str, text: str, page: str, host: str) -> DataFrame:
    """Sections, pages and hosts that hold a term."""
    hits = rows.where(F.contains(F.lower(text), F.lit(term.lower())))
    return hits.agg(F.count(F.lit(1)).alias("sections"), F.count_distinct(page).alias("pages"), F.count_distinct(host).alias("hosts"))


def term_shift(rows: DataFrame, old: str, new: str, text: str, page: str) -> DataFrame:
    """Per page how often an old and a new term stand in its sections, and whether it still has only the old."""
    has = lambda w: F.contains(F.lower(text), F.lit(w.lower()))
    counts = rows.groupBy(page).agg(F.count_if(has(old)).alias("old"), F.count_if(has(new)).alias("new"), F.count_if(has(old) & has(new)).alias("both"))
    return counts.where("old > 0 or new > 0").withColumn("only_old", (F.col("old") > 0) & (F.col("new") == 0))


def _cut(token: str, weights: dict[str, float], shortest: int, longest: int) -> list[str] | None:
    """The words of ``weights`` that cover ``token`` wholly with the greatest sum; null where none do."""
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * len(token)
    for end in range(shortest, len(token) + 1):
        for size in range(shortest, min(longest, end) + 1):
            before, weight = best[end - size], weights.get(token[end - size : end])
            if before is not None and weight is not None and (best[end] is None or before[0] + weight > best[end][0]):
                best[end] = (before[0] + weight, size)
    if best[-1] is None:
        return None
    out, at = [], len(token)
    while at:
        size = best[at][1]
        out.append(token[at - size : at])
        at -= size
    return out[::-1]


def segmenter(vocabulary_df: dict[str, int], shortest: int = 2, longest: int = 12, least_chars: int = 5):  # noqa: ANN201
    """A pandas UDF that splits glued words into vocabulary words which cover them wholly, of the
    greatest sum of ln(total / df) times length; null where that can't be done or isn't due."""
    total = sum(vocabulary_df.values()) or 1
    weights = {w: math.log(total / df) * len(w) for w, df in vocabulary_df.items() if shortest <= len(w) <= longest}

    def one(token: str | None) -> list[str] | None:
        if token is None or len(token) < least_chars or token in vocabulary_df:
            return None
        return _cut(token, weights, shortest, longest)

    @F.pandas_udf("array<string>")
    def split(tokens: pd.Series) -> pd.Series:
        return tokens.map(one)

    return split


def segmented(words: DataFrame, vocabulary: DataFrame, shortest: int = 2, longest: int = 12, least_chars: int = 5) -> DataFrame:
    """``words`` (word: different ones) that ``segmenter`` cuts, with their pieces.

    ``vocabulary`` (term, df) may be of any size: it meets the words by their candidate pieces.
    """
    total = vocabulary.agg(F.sum("df").cast("double").alias("total"))
    due = words.where(F.char_length("word") >= least_chars).join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    parts = f"flatten(transform(sequence(1, char_length(word) - {shortest} + 1), i -> transform(sequence({shortest}, least({longest}, char_length(word) - i + 1)), n -> substring(word, i, n))))"
    parts = due.select("word", F.explode(F.array_distinct(F.expr(parts))).alias("term"))
    known = parts.join(vocabulary, "term").groupBy("word").agg(F.collect_list(F.struct("term", F.col("df").cast("double").alias("df"))).alias("known"))

    @F.pandas_udf("array<string>")
    def split(tokens: pd.Series, terms: pd.Series, dfs: pd.Series, totals: pd.Series) -> pd.Series:
        rows = zip(tokens, terms, dfs, totals, strict=True)
        return pd.Series([_cut(t, {w: math.log(n / df) * len(w) for w, df in zip(ws, ds, strict=True)}, shortest, longest) for t, ws, ds, n in rows], dtype=object)

    cut = known.crossJoin(F.broadcast(total)).select("word", split("word", "known.term", "known.df", "total").alias("pieces"))
    return cut.where("pieces is not null")


def document_kinds(text: Column) -> list[Column]:
    """Flags of what a text looks like."""
    return [
        F.regexp_like(text, F.lit(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}")).alias("dated"),
        F.regexp_like(text, F.lit(r"\|")).alias("table"),
        F.regexp_like(text, F.lit(r"[?？]\s*$")).alias("question"),
        F.regexp_like(text, F.lit(r"(?i)copyright|licensed|©")).alias("legal"),
        (F.char_length(text) < 40).alias("short"),
    ]
