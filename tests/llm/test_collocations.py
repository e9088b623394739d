"""Phrase collocations against SQL and a plain version, and on awkward tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb

from lodestrata.llm import collocations

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_version(rows: list[tuple[str | None, str | None]], least: int, longest: int, top: int, absorbed: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            for d in range(1, longest + 1):
                f.update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        held = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        inside = {
            g[i:j] for g, c in held.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
            if j - i < len(g) and 100 * c >= absorbed * f[g[i:j]]
        }
        found = []
        for g, a in held.items():
            if g in inside:
                continue
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(n: int) -> list[tuple[str | None, str | None]]:
    draw = random.Random(13)
    words = ["New", "york", "é", "가", "a", "b", "c\x00", "😀", "the", "of", "\x1c", "\x85"]
    made = []
    for _ in range(n):
        body = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 4)):
            body.insert(draw.randint(0, len(body)), draw.choice(["new york city hall plan", "in  spite\tof", "X, Y", "a. b", "one\rtwo"]))
        made.append((draw.choice(["en", "fr", None, "und", ""]), draw.choice([" ", "  ", "\t"]).join(body)))
    return [*made, ("en", None), ("de", ""), ("de", " .,; "), (None, "the of " * 3000)]


def test_against_a_plain_version(spark):  # noqa: ANN001, ANN201
    rows = texts(400)
    df = spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, shard int, p string").repartition(5)
    for least, longest, top, absorbed in ((5, 5, 2000, 100), (3, 3, 7, 60), (20, 2, 50, 100)):
        got = sorted(map(tuple, collocations.collocations(df, least, longest, top, absorbed).collect()))
        assert got == plain_version(rows, least, longest, top, absorbed)


def test_many_shards_give_the_same(spark, monkeypatch):  # noqa: ANN001, ANN201
    rows = texts(60)
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "SHARD", 100)
    monkeypatch.setattr(collocations, "MERGED_ROWS", 7)
    made = collocations.Shard()
    made.add([b"A b. c", b"", b"a\tB"])
    assert list(made.number)[1:] == [b"a", b"b", b"c"]
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").repartition(23)
    got = sorted(map(tuple, collocations.collocations(df, 4).collect()))
    assert got == plain_version(rows, 4, 5, 2000, 100)


def test_nothing_found(spark):  # noqa: ANN001, ANN201
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en"), ("a", None)], "text string, lang string")).count() == 0


def test_products_past_64_bits(spark):  # noqa: ANN001, ANN201
    a, n, l, r = 9_000_000_000_000, 9_000_000_000_000_000, 9_500_000_000_000, 9_700_000_000_000
    row = spark.createDataFrame([(a, n, [l, a], [r, a])], "a long, n long, lefts array<long>, rights array<long>")
    cut = row.select(collocations._lowest(row.a, row.n, row.lefts, row.rights, collocations.F.lit(2)).alias("c")).first()["c"]
    assert (cut["score"], cut["k"], cut["l"], cut["r"]) == (1000 * a * n // (l * r), 1, l, r)


def test_against_sql(spark):  # noqa: ANN001, ANN201
    got = sorted(map(tuple, collocations.op13_collocations(spark, SF).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(c.execute(collocations.SQL).fetchall())
    assert got == want
    assert got
