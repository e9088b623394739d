"""The fill-in-middle transformation against SQL and a plain version, and on awkward tables."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest

from lodestrata.llm import fim

SF = "/root/testdata/sf0.001"


def plain_version(doc_id: int | None, text: str | None, plain_from: int = 90, spm_below: int = 20) -> tuple:
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < spm_below:
        return doc_id, n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def awkward_rows() -> list[tuple[int | None, str | None]]:
    draw = random.Random(11)
    letters = ["a", "<", "P", "S", "M", ">", "é", "가", "😀", "\n", "\x00", "<P", "M>", "<<", "<é>", "é"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 7, 40, 600, 3000]))) for _ in range(250)]
    # Cuts and sentinels at the borders of blocks.
    texts += ["x" * (fim.BLOCK - k) + end for k in range(5) for end in ("<P>", "<P", "😀😀", "<M>" + "y" * 2000, "가" * 700)]
    texts += ["", None, "<S>", "word " * 60_000, "가" * 200_000]
    rows = [*enumerate(texts), (None, "no id at all"), (-5, "negative"), (7, texts[7]), (7, texts[7])]
    return rows


def test_against_a_plain_version(spark):  # noqa: ANN001, ANN201
    rows = awkward_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, h1 int").repartition(3)
    made = fim.fill_in_middle(df)
    got = made.withColumn("back", fim.restored(made["output"], made["form"])).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_version(*r) for r in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    texts = {(i, t or "") for i, t in rows}
    assert {(r["id"], r["back"]) for r in got} == texts


def test_shares_are_parameters(spark):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(i, "some text here") for i in range(50)], "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(df, 0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(df, 100, 0).collect()} == {"psm"}
    assert {r["form"] for r in fim.fill_in_middle(df, 100, 100).collect()} == {"spm"}


def test_counts_of_the_automaton():  # noqa: ANN201
    texts = ["a<P>b<S><M>", "<<P>>", "<P", "", "é<M>", "<é>P>"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    scan = fim.Scan(np.frombuffer(data, np.uint8), offsets)
    assert scan.units.tolist() == [len(t) for t in texts]
    assert scan.sentinels.tolist() == [3, 1, 0, 0, 1, 0]


def test_empty_table(spark):  # noqa: ANN001, ANN201
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_against_sql(spark):  # noqa: ANN001, ANN201
    got = fim.op11_fim(spark, SF).toPandas().sort_values("doc_id")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = c.execute(fim.SQL).df().sort_values("doc_id")
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda x: [tuple(map(str, r)) for r in x[sorted(x.columns)].fillna(-1).astype({"prefix_chars": int, "middle_chars": int}).itertuples(index=False)]
    assert show(got) == show(want)
    assert (got.restored_sha256 == want.restored_sha256).all()


@pytest.mark.parametrize("size", [1, fim.BLOCK - 1, fim.BLOCK, fim.BLOCK + 1, 3 * fim.BLOCK])
def test_places_are_the_starts_of_units(size):  # noqa: ANN001, ANN201
    text = ("a가é😀" * size)[:size]
    data = text.encode()
    scan = fim.Scan(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    units = np.arange(size + 1)
    assert scan.places(np.zeros(size + 1, int), units).tolist() == [len(text[:k].encode()) for k in units]
