"""Lookups by topic: calendar entries, posts, recruiting notices, titles of a page's blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.dates import title_deadline
from lodestrata.functions.predicates import is_activity, is_finished
from lodestrata.functions.text import bare_name, spaceless, squeeze, starts_word
from lodestrata.operators.facts import contains_any, open_on


def topic_of(utterance: Column, aliases: dict[str, str]) -> Column:
    """The topic whose longest alias begins a word of the message, spaces aside; null if none does."""
    bare = spaceless(utterance)
    out = F.lit(None).cast("string")
    for alias, topic in sorted(aliases.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(starts_word(bare, alias.replace(" ", "")), topic).otherwise(out)
    return out


def entries_on(entries: DataFrame, keywords: list[str], today: Column, title: str = "title", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Entries whose titles hold a keyword, spaces aside: running and coming ones first, the nearest
    first, then past ones, the latest first."""
    bare = spaceless(F.col(title))
    hit = reduce(Column.__or__, [F.contains(bare, F.lit(k.replace(" ", ""))) for k in keywords])
    past = F.coalesce(F.col(end), F.col(start)) < today
    away = F.when(past, F.datediff(today, F.col(start))).otherwise(F.datediff(F.col(start), today))
    return entries.where(hit).withColumns({"past": past, "away": away}).orderBy("past", "away", title)


def posts_on(posts: DataFrame, tokens: list[str], today: Column, limit: int = 50, title: str = "title", body: str = "body", deadline: str = "deadline", key: str = "post_key") -> DataFrame:
    """Open posts that hold a token in title or body, newest first."""
    hits = posts.where(contains_any([title, body], tokens) & open_on(today, deadline))
    return hits.orderBy(F.desc_nulls_last("published_at"), key).limit(limit)


def recruiting(notices: DataFrame, today: Column, order: list[Column], title: str = "title", published: str = "published_at") -> DataFrame:
    """Notices with what becomes of them: same_title, finished, past, or null for those to show.

    Of equal titles the first in order counts; to show them, activities go first, then the newest.
    """
    w = Window.partitionBy(squeeze(F.col(title))).orderBy(*order)
    named = title_deadline(F.col(title), F.col(published))
    out = notices.withColumn("_n", F.row_number().over(w))
    why = F.when(F.col("_n") > 1, "same_title").when(is_finished(F.col(title)), "finished").when(named < today, "past")
    return out.withColumns({"dropped": why, "activity": is_activity(F.col(title)), "deadline": named}).drop("_n")


def exact_block(blocks: DataFrame, utterance: str, title: str = "title") -> DataFrame:
    """Of each page the first block whose bare title is the bare message."""
    wanted = bare_name(F.lit(utterance))
    hits = blocks.where((bare_name(F.col(title)) == wanted) & (wanted != ""))
    return hits.groupBy("page").agg(F.min_by(F.struct("ordinal", title), "ordinal").alias("b")).select("page", "b.*")


def chosen(options: Column, utterance: Column) -> Column:
    """The option that the message names, bare names compared; null if none."""
    return F.try_element_at(F.filter(options, lambda o: bare_name(o) == bare_name(utterance)), F.lit(1))


def narrowed(options: Column, utterance: Column) -> Column:
    """Whether a message holds exactly one option's bare name."""
    return F.size(F.filter(options, lambda o: F.contains(bare_name(utterance), bare_name(o)))) == 1
