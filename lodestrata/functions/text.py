"""Text: normalising, tokenising, particles, splitting, clipping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that ask but name nothing.  An institution adds its own names.
STOPWORDS = (
    "뭐야", "뭐", "머야", "알려줘", "알려", "어떻게", "어떡해", "언제", "어디", "얼마", "얼마나", "누구", "왜", "무엇", "무슨", "어떤", "인가요", "인가",
    "있나요", "있어", "없어", "해줘", "해", "하나요", "하는지", "하려면", "되나요", "돼", "되나", "좀", "제발", "궁금", "궁금해", "질문", "문의", "정보",
    "안내", "해요", "하죠", "할래", "주세요", "알려주세요", "가르쳐줘", "말해줘", "방법", "관련", "대해", "대한", "그리고", "근데", "혹시", "우리학교", "학교",
    "챗봇", "안녕", "안녕하세요", "안녕하십니까", "하이", "반가워", "고마워", "감사합니다", "잘가", "수고", "ㅎㅇ", "ㅋㅋ", "ㅎㅎ",
)
#: Endings that are taken off, the first that fits.
SUFFIXES = (
    "하려면", "하려고", "하고싶어", "하는법", "합니까", "인가요", "이야", "예요", "이에요", "이요", "하나요", "할까요", "해야해", "해야", "하기", "으로부터",
    "에서부터", "이라고", "라고", "으로", "에서", "부터", "까지", "에게", "한테", "이랑", "랑", "은", "는", "이", "가", "을", "를", "의", "도", "만",
    "와", "과", "로", "에", "야", "요",
)
MIN_TOKEN, MAX_TOKENS = 2, 8


def squeeze(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def spaceless(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def slug(text: Column) -> Column:
    """Compatibility form, reserved characters and white space as one hyphen."""
    return F.regexp_replace(F.trim(nfkc(text)), r"[\s/#?%&:]+", "-")


def plain_name(text: Column) -> Column:
    """A name without bracket characters (what they hold stays) and white space."""
    return F.regexp_replace(text, r"[\s()\[\]{}<>]+", "")


def normalized_name(text: Column) -> Column:
    """``plain_name`` of the compatibility form."""
    return plain_name(nfkc(text))


def bare_name(text: Column) -> Column:
    """Lower case without spaces and punctuation, for comparing names."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Punct}]+", ""))


def without_suffix(token: Column) -> Column:
    """A token of three or more characters without its first fitting ending, two characters at least
    staying."""
    out = token
    for suffix in reversed(SUFFIXES):
        fits = token.endswith(suffix) & (F.char_length(token) - len(suffix) >= MIN_TOKEN)
        out = F.when(fits, F.substring(token, F.lit(1), F.char_length(token) - len(suffix))).otherwise(out)
    return F.when(F.char_length(token) < 3, token).otherwise(out)


def tokens(utterance: Column, stopwords: list[str] | None = None) -> Column:
    """Words of a question in order, each once, at most eight: stop words out, endings off, grades
    like A+ kept."""
    stops = F.array(*map(F.lit, STOPWORDS if stopwords is None else stopwords))
    raw = F.split(F.coalesce(utterance, F.lit("")), r"[^0-9A-Za-z가-힣+]+")
    bare = F.transform(raw, lambda w: F.when(F.regexp_like(w, F.lit(r"^\+*[0-9]+\+*$")), F.replace(w, F.lit("+"), F.lit(""))).otherwise(w))
    first = F.filter(bare, lambda w: (w != "") & ~F.array_contains(stops, w))
    cut = F.transform(first, without_suffix)
    kept = F.filter(
        cut,
        lambda t: ~F.array_contains(stops, t) & ((F.char_length(t) >= MIN_TOKEN) | F.regexp_like(t, F.lit("^[A-Za-z][+-]$"))),
    )
    return F.slice(F.array_distinct(kept), 1, MAX_TOKENS)


def grams(text: Column, n: int = 3) -> Column:
    """The n-grams of a text in lower case; none of texts that are shorter."""
    low = F.lower(text)
    last = F.char_length(low) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    )


def has_final_consonant(word: Column) -> Column:
    """Whether the last character is read with a final consonant; null where that can't be told."""
    bare = F.regexp_replace(word, "[\\s.,!?~)\\]}'\"”’]+$", "")
    last = F.substring(bare, -1, 1)
    code = F.ascii(last)
    return (
        F.when(F.char_length(bare) == 0, F.lit(None).cast("boolean"))
        .when((code >= 0xAC00) & (code <= 0xD7A3), (code - 0xAC00) % 28 != 0)
        .when(F.regexp_like(last, F.lit("[0-9]")), F.regexp_like(last, F.lit("[013678]")))
        .when(F.regexp_like(last, F.lit("[A-Za-z]")), F.regexp_like(F.lower(last), F.lit("[lmnr]")))
    )


def particle(word: Column, with_final: str, without_final: str) -> Column:
    """The particle that fits a word; the one for open syllables where that can't be told."""
    chosen = F.when(F.coalesce(has_final_consonant(word), F.lit(False)), with_final).otherwise(without_final)
    if (with_final, without_final) != ("으로", "로"):
        return chosen
    last = F.ascii(F.substring(F.regexp_replace(word, "[\\s.,!?~)\\]}'\"”’]+$", ""), -1, 1))
    return F.when((last >= 0xAC00) & (last <= 0xD7A3) & ((last - 0xAC00) % 28 == 8), without_final).otherwise(chosen)


def cell_items(cell: Column) -> Column:
    """Items of a table cell: split at line feeds, then at slashes, never at spaces."""
    parts = F.flatten(F.transform(F.split(cell, r"\n"), lambda line: F.split(line, "/")))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def comma_parts(label: Column, least: int = 2) -> Column:
    """The parts of a label at commas if at least two are long enough, else the label itself."""
    parts = F.filter(F.transform(F.split(label, ","), lambda p: F.trim(p)), lambda p: F.char_length(p) >= least)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(F.trim(label)))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def clip_at_sentence(text: Column, limit: int = 700) -> Column:
    """The longest run of whole sentences within the limit; a clip where no sentence ends in it."""
    head = F.substring(text, 1, limit)
    whole = F.regexp_extract(head, r"^([\s\S]*[.!?])(?:\s|$)", 1)
    return F.when(F.char_length(text) <= limit, text).when(whole != "", whole).otherwise(clip(text, limit))


def without_leading_title(text: Column, title: Column) -> Column:
    """A text without its title in front, whatever spaces and punctuation stand between the letters."""
    letters = F.filter(F.split(F.regexp_replace(title, r"[\s\p{Punct}]+", ""), ""), lambda c: c != "")
    pattern = F.concat(F.lit(r"^[\s\p{Punct}]*\Q"), F.array_join(letters, r"\E[\s\p{Punct}]*\Q"), F.lit(r"\E[\s\p{Punct}]*"))
    return F.when(F.size(letters) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)


@F.pandas_udf(T.StringType())
def longest_common(left: pd.Series, right: pd.Series) -> pd.Series:
    """The longest common substring of two short texts, the first of equally long ones."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        best, before = "", [0] * (len(b) + 1)
        for i, c in enumerate(a):
            now = [0] * (len(b) + 1)
            for j, d in enumerate(b):
                if c == d:
                    now[j + 1] = before[j] + 1
                    if now[j + 1] > len(best):
                        best = a[i + 1 - now[j + 1] : i + 1]
            before = now
        return best

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


def without_words(label: Column, words: Column) -> Column:
    """A label without the given words, the longest taken out first."""
    ordered = F.array_sort(words, lambda a, b: F.char_length(b) - F.char_length(a))
    return squeeze(F.aggregate(ordered, label, lambda left, w: F.replace(left, w, F.lit(""))))


def unescaped(html: Column) -> Column:
    """A fragment of HTML as text: breaks as line feeds, tags off, common references decoded."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), "<[^>]*>", "")
    for reference, shown in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(shown))
    return F.trim(out)


def wordwise_contains(text: Column, needle: str) -> Column:
    """Whether ``needle`` stands in a text with a non-Hangul neighbour on at least one side."""
    quoted = F.lit(rf"(?<![가-힣])\Q{needle}\E|\Q{needle}\E(?![가-힣])")
    return F.regexp_like(text, quoted)


def starts_word(text: Column, needle: str) -> Column:
    """Whether ``needle`` stands in a text with no Hangul right before it."""
    return F.regexp_like(text, F.lit(rf"(?<![가-힣])\Q{needle}\E"))


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether a text holds any of the needles, case aside."""
    low = F.lower(text)
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(low, F.lit(needle.lower()))
    return found
