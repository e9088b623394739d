"""One document of each group: repeated and missing ids, links of either kind."""

from __future__ import annotations

import random

from lodestrata.llm import near_dedup
from lodestrata.llm.simhash_dedup import fingerprint


def stays(spark, rows):  # noqa: ANN001, ANN201
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, row_number int").repartition(3)
    return sorted(near_dedup.one_of_each(df).collect(), key=str), df.columns


def test_ids_that_repeat_or_miss(spark):  # noqa: ANN001, ANN201
    x, y = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, y, "p", 1), (2, x, "q", 2), (2, y, "r", 3), (2, y, "r", 3), (None, x, "s", 4), (None, "only here without an id", "t", 5), (4, None, "u", 6), (3, " ", "v", 7)]
    got, columns = stays(spark, rows)
    assert columns == ["doc_id", "text", "fp", "row_number"]
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[5], rows[7]], key=str)


def test_repeated_rows_leave_one(spark):  # noqa: ANN001, ANN201
    assert [tuple(r) for r in stays(spark, [(5, "same text", "a", 1)] * 4 + [(None, "same text", "a", 1)])[0]] == [(5, "same text", "a", 1)]


def test_links_beyond_the_reach_of_fingerprints(spark):  # noqa: ANN001, ANN201
    draw = random.Random(3)
    base = [f"w{draw.randrange(10_000)}" for _ in range(120)]
    near = list(base)
    for at in (30, 90):  # ten of 116 shingles are others: 0.84
        near[at] = "changed"
    texts = [" ".join(base), " ".join(near)]
    assert (fingerprint(texts[0], 5) ^ fingerprint(texts[1], 5)).bit_count() > 4
    assert [r["doc_id"] for r in stays(spark, [(9, texts[0], "", 0), (8, texts[1], "", 0), (7, "another text of its own words", "", 0)])[0]] == [7, 8]


def test_empty_table(spark):  # noqa: ANN001, ANN201
    assert stays(spark, [])[0] == []
