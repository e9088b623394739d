"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestrata import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def shown(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (datetime.date, datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(shown, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, duck, name):  # noqa: ANN001, ANN201
    got, want = plans.queries()[name](spark, SF).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):  # noqa: ANN001, ANN201
    found = plans.queries()[name](spark, SF)
    got = found.collect()
    assert got
    # No row is empty, and none is there twice.
    assert all(any(v is not None for v in r) for r in got)
    assert len(set(map(str, got))) == len(got)


def test_segment_words_against_brute_force(spark):  # noqa: ANN001, ANN201
    df = {r["term"]: r["df"] for r in plans.queries()["vocabulary_df"](spark, SF).collect()}
    total = sum(df.values())

    def cuts(word: str) -> list[list[str]]:
        heads = [word[:n] for n in range(2, min(12, len(word)) + 1) if word[:n] in df]
        return [[h, *rest] for h in heads for rest in (cuts(word[len(h) :]) if h != word else [[]])]

    def weight(pieces: list[str]) -> float:
        return sum(math.log(total / df[p]) * len(p) for p in pieces)

    text = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("explode(split(lower(text), '[^\\\\p{L}]+')) as word").distinct()
    words = [r["word"] for r in text.collect() if r["word"] is not None]
    want = {w: max(map(weight, c)) for w in words if 5 <= len(w) and w not in df and (c := cuts(w))}
    got = {r["word"]: r["pieces"].split("+") for r in plans.queries()["segment_words"](spark, SF).collect()}
    assert want
    assert {w: round(weight(p), 6) for w, p in got.items()} == {w: round(n, 6) for w, n in want.items()}
    assert all("".join(p) == w for w, p in got.items())
