"""Chunked builds broken off and resumed, contents parsed by version, recorded runs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import corpus, run_records
from lodestrata.sources import reparse
from lodestrata.streaming import page_build

SCHEMA = "page long, profile string, text string"


def rows() -> list[tuple]:
    return [(p, f"h{p % 2}", t) for p in range(40) for t in ("the same footer", f"own text of page {p}", f"shared by some {p % 4}")]


def deliver(spark, path, made, mode="append"):  # noqa: ANN001, ANN201
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def state(frame) -> set[tuple]:  # noqa: ANN001
    return {(r["profile"], r["page"], r["digest"], r["text"], r["held"]) for r in frame.collect()}


def batch(spark, made):  # noqa: ANN001, ANN201
    found = corpus.fragments(spark.createDataFrame(made, SCHEMA), "profile", "page", "text")
    return state(corpus.prune(found, corpus.boilerplate(found)))


def test_a_build_that_breaks_off_is_resumed(spark, tmp_path, monkeypatch):  # noqa: ANN001, ANN201
    pages, work, made = str(tmp_path / "in"), str(tmp_path / "work"), rows()
    for k in range(4):
        deliver(spark, pages, [r for r in made if r[0] % 4 == k])
    tried = []

    def parse(chunk):  # noqa: ANN001, ANN202
        tried.append(1)
        if len(tried) == 3:  # the third chunk's rows are read, then the job dies
            return chunk.withColumn("text", F.raise_error(F.lit("killed")))
        return chunk

    with pytest.raises(Exception, match="killed"):
        page_build.first_pass(spark, pages, SCHEMA, work, parse)
    assert page_build.ledger(spark, work).count() == 2
    page_build.first_pass(spark, pages, SCHEMA, work, parse)
    assert page_build.ledger(spark, work).count() == 4
    assert len(tried) == 5
    prune, pruned = corpus.prune, []

    def dies(found, judged):  # noqa: ANN001, ANN202
        pruned.append(1)
        if len(pruned) == 2:
            raise RuntimeError("killed again")
        return prune(found, judged)

    monkeypatch.setattr(corpus, "prune", dies)
    with pytest.raises(Exception, match="killed again"):
        page_build.second_pass(spark, work)
    page_build.second_pass(spark, work)
    assert len(pruned) == 5
    monkeypatch.setattr(corpus, "prune", prune)
    assert state(page_build.built(spark, work)) == batch(spark, made)
    assert "the same footer" not in {r["text"] for r in page_build.built(spark, work).collect()}


def test_contents_are_parsed_once_a_version(spark, tmp_path):  # noqa: ANN001, ANN201
    store, parsed = str(tmp_path), []
    seen = lambda day, pages: spark.createDataFrame([(u, b, dt.datetime(2024, 5, day)) for u, b in pages], "url string, body string, fetched_at timestamp")

    def lines(contents):  # noqa: ANN001, ANN202
        parsed.append(sorted(r["body"] for r in contents.collect()))
        return contents.where("body <> ''").select("content", F.explode(F.split("body", ",")).alias("line"))

    assert reparse.reparse(spark, store, "a", lines) == {"parsed": 0, "kept": 0}
    assert reparse.save(seen(1, [("u1", "x,y"), ("u2", "x,y"), ("u3", None), ("u4", "z?v=1")]), store) == 3
    assert reparse.reparse(spark, store, "a", lines) == {"parsed": 3, "kept": 0}
    assert reparse.reparse(spark, store, "a", lines) == {"parsed": 0, "kept": 3}
    assert reparse.save(seen(2, [("u1", "w"), ("u4", "z?v=2"), ("u2", "x,y")]), store) == 1
    assert reparse.reparse(spark, store, "a", lines) == {"parsed": 1, "kept": 3}
    assert parsed == [["", "x,y", "z?v=1"], ["w"]]
    assert sorted(map(tuple, reparse.latest(spark, store, "a").collect())) == [("u1", "w"), ("u2", "x"), ("u2", "y"), ("u4", "z?v=1")]
    assert reparse.reparse(spark, store, "b", lines) == {"parsed": 4, "kept": 0}


def test_an_address_seen_twice_at_once_counts_twice(spark, tmp_path):  # noqa: ANN001, ANN201
    store, shape = str(tmp_path), "url string, body string, fetched_at timestamp"
    seen = [("u1", "old", 1), ("u1", "a", 2), ("u1", "b", 2), ("u2", "c", 2), ("u2", "c", 2), (None, "d", 2)]
    reparse.save(spark.createDataFrame([(u, b, dt.datetime(2024, 5, day)) for u, b, day in seen], shape), store)
    reparse.reparse(spark, store, "1", lambda rows: rows.select("content", F.col("body").alias("title")))
    got = [(r["url"], r["title"]) for r in reparse.latest(spark, store, "1").collect()]
    assert sorted(got, key=str) == [("u1", "a"), ("u1", "b"), ("u2", "c"), ("u2", "c"), (None, "d")]


def test_runs_are_recorded(spark, tmp_path):  # noqa: ANN001, ANN201
    runs, out = str(tmp_path / "runs"), str(tmp_path / "out")
    frame = spark.createDataFrame([(i, i % 5 == 0) for i in range(20)], "a int, bad boolean")
    write = lambda df: df.where("not bad").write.mode("overwrite").parquet(out)
    at = lambda hour: dt.datetime(2024, 5, 1, hour, tzinfo=dt.UTC)
    assert run_records.recorded(spark, runs, "menu", lambda: frame, write, now=at(1))["outcome"] == "success"
    apart = run_records.recorded(spark, runs, "menu", lambda: frame, write, F.col("bad"), now=at(2))
    assert (apart["outcome"], apart["rows"], apart["set_apart"]) == ("quarantine", 20, 4)

    def fails():  # noqa: ANN202
        raise ConnectionError("no answer" * 100)

    with pytest.raises(ConnectionError):
        run_records.recorded(spark, runs, "menu", fails, write, now=at(3))
    table = spark.read.parquet(runs)
    assert sorted((r["started_at"].hour, r["outcome"], r["rows"]) for r in table.collect()) == [(1, "success", 20), (2, "quarantine", 20), (3, "error", None)]
    assert table.select("run_id").distinct().count() == 3
    last = run_records.last_runs(spark, runs).first()
    assert (last["outcome"], len(last["error"])) == ("error", run_records.MOST_ERROR_CHARS)
    assert last["last_success"] is not None
    # A job without rows is a success of no rows.
    assert run_records.recorded(spark, runs, "none", lambda: frame.limit(0), write)["rows"] == 0
