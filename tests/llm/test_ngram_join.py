"""The n-gram Jaccard join against all pairs, and on awkward tables."""

from __future__ import annotations

import random
import re

import pyarrow.parquet as pq
import pytest

from lodestrata.llm import ngram_join

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, words: int) -> frozenset[tuple[str, ...]]:
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([tuple(parts)] if parts else []))


def all_pairs(rows: list[tuple[int, str | None]], words: int = 5, percent: int = 80) -> list[tuple[int, int, int]]:
    """Components by comparing every pair; ``rows`` have different ids."""
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    holders: dict[tuple[str, ...], list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in holders[t] if j > i}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(name, least.get(find(i), name))
    return sorted((name, len(sets[i]), least[find(i)]) for i, (name, _) in enumerate(rows))


def found(spark, rows, **more):  # noqa: ANN001, ANN003, ANN201
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(4)
    return sorted((r["id"], r["n"], r["component_id"]) for r in ngram_join.ngram_components(df, **more).collect())


def groups_of_copies(draw: random.Random) -> list[str]:
    """Groups around the threshold, chains, a passage that many share, and one large group."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    texts = []
    for size in (2, 3, 5, 8, 60):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 20, 90]))]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            texts.append(" ".join(text[draw.randint(0, 2) :]))
    chain = [draw.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[3:] + [draw.choice(vocabulary) for _ in range(3)]
    for _ in range(40):
        texts.append(" ".join([draw.choice(vocabulary) for _ in range(draw.choice([0, 3, 8, 40]))] + passage + [draw.choice(vocabulary) for _ in range(draw.choice([0, 2, 5, 30]))]))
    return texts


def test_against_all_pairs(spark, monkeypatch):  # noqa: ANN001, ANN201
    monkeypatch.setattr(ngram_join, "CHUNK", 300)
    monkeypatch.setattr(ngram_join, "BUCKET", 500)
    texts = [t for seed in (1, 2) for t in groups_of_copies(random.Random(seed))]
    texts += ["one two", "ONE  two\n", "one", "", None, " \t\n", "a b c d e", "A b\x0bc d e", "é É", "É é", "x " * 40, "x " * 6, "x x x x x", "y " * 30_000, "y " * 29_999 + "z"]
    rows = list(enumerate(texts, 100))
    random.Random(3).shuffle(rows)
    got = found(spark, rows)
    assert got == all_pairs(rows)
    assert len({c for _, _, c in got}) < len(rows) - 60


def test_other_sizes_and_thresholds(spark):  # noqa: ANN001, ANN201
    rows = list(enumerate(groups_of_copies(random.Random(7))))
    assert found(spark, rows, words=2, percent=60) == all_pairs(rows, 2, 60)


def test_awkward_rows(spark):  # noqa: ANN001, ANN201
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (4, text.upper()), (None, text), (None, "nobody else has these words at all"), (7, None), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["id"], r["n"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == [(1, 6, 1), (1, 6, 1), (4, 6, 1), (7, 0, 7), (8, 0, 8), (None, 0, None), (None, 2 + 1, None), (None, 6, 1)]


def test_empty_table(spark):  # noqa: ANN001, ANN201
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [1, 50, 80, 95, 100])
def test_starts_of_partners_share_what_they_need(percent):  # noqa: ANN001, ANN201
    """Sets of sizes n and m that just reach the similarity, their shared tokens as late as can be in one of them."""
    for n in range(1, 90):
        for m in range(n, 90):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared > n:
                continue
            for one, other in ((n, m), (m, n)):
                own = max(0, ngram_join.start_of(one, percent) - (one - shared))
                theirs = max(0, ngram_join.start_of(other, percent) - (other - shared))
                assert min(own, theirs) >= max(ngram_join.start_needs(n, percent), ngram_join.start_needs(m, percent))


def test_on_a_table(spark):  # noqa: ANN001, ANN201
    t = pq.read_table(f"{SF}/documents.parquet")
    want = all_pairs(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.op12_ngram_join(spark, SF).collect())
    assert got == want
