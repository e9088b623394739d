"""Row numbers of large groups against plain counting."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestrata.operators import changes, ranking
from lodestrata.sources import links


def plain(rows, reverse=False):  # noqa: ANN001, ANN201
    out, seen = {}, {}
    for key, value in sorted(rows, key=lambda r: (r[0] or "", -r[1] if reverse else r[1])):
        seen[key] = seen.get(key, 0) + 1
        out[key, value] = seen[key]
    return out


def test_numbers_of_a_hot_group(spark):  # noqa: ANN001, ANN201
    rng = random.Random(3)
    values = rng.sample(range(10_000), 3000)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None, f"k{i}"]), v) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "k string, v long").repartition(5)
    for reverse, order in ((False, F.col("v").asc()), (True, F.col("v").desc())):
        got = {(r["k"], r["v"]): r["place"] for r in ranking.numbered(table, ["k"], [order], ranges=16).collect()}
        assert got == plain(rows, reverse)


def test_no_task_has_the_hot_group(spark):  # noqa: ANN001, ANN201
    table = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("v"))
    ranking.stored, keep, held = lambda df, name: held.append(keep(df, name)) or held[-1], ranking.stored, []
    try:
        got = ranking.numbered(table, ["k"], [F.col("v")], ranges=20)
    finally:
        ranking.stored = keep
    assert got.where("place = v + 1").count() == 20_000
    sizes = [r["count"] for r in held[0].groupBy("_range0").count().collect()]
    assert len(sizes) >= 18
    assert max(sizes) < 20_000 / 8


def test_awkward(spark):  # noqa: ANN001, ANN201
    rows = [(None, 1, "x"), (None, 1, "y"), ("a", None, "z"), ("a", 2, None)]
    table = spark.createDataFrame(rows, "k string, v long, _range0 string")
    got = ranking.numbered(table, ["k"], [F.col("v").asc_nulls_first()], name="_before0")
    assert got.columns == ["k", "v", "_range0", "_before0"]
    assert sorted((r["k"] or "", r["_before0"]) for r in got.collect()) == [("", 1), ("", 2), ("a", 1), ("a", 2)]
    replaced = ranking.numbered(table.withColumn("place", F.lit("old")), ["k"], [F.col("v")])
    assert replaced.columns == [*table.columns, "place"]
    assert dict(replaced.dtypes)["place"] == "bigint"
    assert ranking.numbered(table.limit(0), ["k"], [F.col("v")]).count() == 0
    no_keys = ranking.numbered(spark.range(100), [], [F.desc("id")])
    assert {r["id"]: r["place"] for r in no_keys.collect()} == {i: 100 - i for i in range(100)}


def test_turns_and_menus(spark):  # noqa: ANN001, ANN201
    turns = changes.round_robin(spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "g string, v long"), "g", [F.col("v")], "v")
    assert sorted((r["g"] or "", r["v"], r["turn"], r["seen"]) for r in turns.collect()) == [("", 4, 1, 4), ("", 5, 2, 4), ("a", 1, 1, 1), ("a", 2, 2, 1)]
    page = "<a href='/b'>b</a><a class=x href=\"/a\">a</a><a href=''></a><a href='/b'>again</a>"
    rows = [(2, "http://x.org/2", "<a href='/c'></a><a href='/a'></a>"), (1, "http://x.org/1", page), (3, "http://y.org/", page), (4, None, page), (5, "http://z.org/", None)]
    menus = links.menu_order(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["host"], r["place"], r["href"]) for r in menus) == [("x.org", 1, "/b"), ("x.org", 2, "/a"), ("x.org", 3, "/c"), ("y.org", 1, "/b"), ("y.org", 2, "/a")]
