"""The operators of ``lodestrata.llm`` against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from xml.etree import ElementTree

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrata.llm import ann, bpe, bpe_codec, entries, exact_dedup, html_text, lexicon, line_dedup, packing, pii, quality, sharding, simhash_dedup
from lodestrata.llm.components import components

SF = "/root/testdata/sf0.001"
#: Null texts and ids, empty and long texts, ties, repeated rows, and columns that clash with ours.
AWKWARD = [
    (1, "the same text\nand a line", "a", 1), (2, "the same text\nand a line", "b", 2), (2, "the same text\nand a line", "b", 2), (3, None, "c", 3),
    (4, "", None, 4), (None, "no id here at all", "d", 5), (5, "word " * 30_000, "e", 6), (6, " \n\t\n", "f", None), (7, "x@y.zz 1.2.3.4 +12 345 678 90", "g", 8),
]
SHAPE = "doc_id long, text string, gone string, fp int"


@pytest.fixture(scope="module")
def vocabulary():  # noqa: ANN201
    return bpe.Vocabulary(bpe_codec.default_vocabulary())


@pytest.fixture(scope="module")
def library():  # noqa: ANN201
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    path = str(tmp_path_factory.mktemp("t") / "documents.parquet")
    spark.createDataFrame(AWKWARD, SHAPE).coalesce(2).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    path = str(tmp_path_factory.mktemp("e") / "documents.parquet")
    spark.createDataFrame([], SHAPE).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def docs():  # noqa: ANN201
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_sharding", "op5_line_dedup"])
def test_against_sql(spark, name):  # noqa: ANN001, ANN201
    got = entries.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = c.execute(entries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    show = lambda x: sorted(map(tuple, x[columns].astype(str).itertuples(index=False)))
    assert show(got) == show(want)


# Exact dedup


def test_exact_dedup_awkward(spark, awkward):  # noqa: ANN001, ANN201
    rows = [(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark, awkward).collect()]
    assert len(rows) == len(AWKWARD)
    assert [r[1:3] for r in rows if r[0] in (1, 2)] == [(2, 3)] * 3
    assert sum(r[3] for r in rows if r[0] in (1, 2)) == 1
    assert {r for r in rows if r[0] in (3, 4)} == {(3, 4, 2, False), (4, 4, 2, True)}
    assert [r for r in rows if r[0] is None] == [(None, None, 1, True)]


def test_exact_dedup_in_many_batches(spark, tmp_path):  # noqa: ANN001, ANN201
    texts = [f"text {i % 7}" for i in range(60)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(path)
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, path, files_per_batch=1).collect()}
    assert got == {i: (max(j for j in range(60) if j % 7 == i % 7), sum(j % 7 == i % 7 for j in range(60))) for i in range(60)}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):  # noqa: ANN001, ANN201
    path, state = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    found = lambda: sorted((r["n"], r["keep_id"]) for r in exact_dedup.registry(spark, path, state_path=state).collect())
    deliver = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    deliver([(1, "a"), (2, "b"), (3, "a")])
    assert found() == [(2, 3)]
    deliver([(4, "b"), (9, "a"), (5, "c")])
    assert found() == [(2, 4), (3, 9)]
    assert found() == [(2, 4), (3, 9)]


def test_exact_dedup_checks_bytes(spark, tmp_path):  # noqa: ANN001, ANN201
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string").write.parquet(path)
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 0)  # noqa: E731  every text has the same digest
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark, path, digest=weak).collect()}
    assert got == {i: (15 + i % 5, 4, i >= 15) for i in range(20)}


def test_exact_dedup_empty(spark, empty):  # noqa: ANN001, ANN201
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


# HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("just words", "just words"),
        ("<p>a<p>b &amp; c", "a\nb & c"),
        ("<nav><a>menu</a></nav><div class=ad>buy now</div><article><h1>T</h1><p>text of   the\narticle &eacute;<br>goes on</p><p>Short.</p><aside>side</aside><div class='comments'><p>I say</p></div></article><footer>f</footer>", "T\ntext of the article é goes on\nShort."),
        ("<script>var a='</p>';</script><style>p{}</style><article><p>one <b>bold</b>word</article>", "one boldword"),
        ("<nav><ul><li>never closed<article><p>still the article</article>", "still the article"),
        ("<main><p>text</p><form><p>sign up</p><input></form><p>more</p></main>", "text\nmore"),
    ],
)
def test_main_text(page, want):  # noqa: ANN001, ANN201
    assert html_text.main_text(page) == want


def test_pages_without_an_article_element():  # noqa: ANN201
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(12))
    body = "".join(f"<p>paragraph {i} with a good deal of running text in it, as articles have.</p>" for i in range(8))
    assert html_text.main_text(f"<body><ul>{links}</ul><div><div>{body}</div></div><ul>{links}</ul></body>").count("\n") == 7


BODY = "<p>" + "A long sentence of the body that says something. " * 6 + "</p>"
PROSE = ("A long sentence of the body that says something. " * 6).strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=x><body>{BODY}</body></html>",
        f"<html><head><title>t</title>{BODY}",
        f"<html><head><title>t</title><noscript><p>off</p></noscript></head><body>{BODY}",
        f"<body><div class='has-sidebar'>{BODY}<div class='sidebar'>x <a>y</a></div></div></body>",
        f"<body><div class='social-science'>{BODY}</div></body>",
        f"<body><article class='post comments-open'>{BODY}<div class='comments'><p>me too</p></div></article></body>",
        f"<body><article>{BODY}</article><div class='comments'>{'<p>me too, and at some length</p>' * 40}</div></body>",
        f"<body><p hidden>{'x ' * 900}</p>{BODY}</body>",
    ],
)
def test_pages_lose_no_body(page):  # noqa: ANN001, ANN201
    assert html_text.main_text(page) == PROSE


def plain_regions(root: ElementTree.Element) -> str:
    """The rules of ``html_text`` over a well-formed page, each by its definition."""
    lines, above, order = [], {}, []

    def share(e: ElementTree.Element) -> float:
        words = set((e.get("class") or "").split())
        return 0.02 if e.tag in ("nav", "footer", "aside") or words & html_text.NAMED else 1.0

    def walk(e: ElementTree.Element, inside: ElementTree.Element) -> None:
        if e.tag in html_text.CONTAINERS:
            above[e], inside = inside, e
            order.append(e)
        if e.tag in ("p", "h1", "li"):
            links = sum(len(a.text) for a in e.iter("a"))
            lines.append([inside, "".join(e.itertext()), links, e.tag])
        for child in e:
            walk(child, inside)

    walk(root, None)

    def inside(k: int, e: ElementTree.Element) -> bool:
        at = lines[k][0]
        while at is not None and at is not e:
            at = above[at]
        return at is e

    html = ElementTree.tostring(root, encoding="unicode")
    page = html_text.PageLines()
    page.feed(html)
    tags = [x.tags for x in page.finish()]
    n = len(lines)
    weights = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
    values = []
    for k, (at, *_) in enumerate(lines):
        ratio = sum(w * len(lines[j][1]) / max(1, tags[j]) for w, j in zip(weights, range(k - 3, k + 4), strict=True) if 0 <= j < n) / sum(weights)
        while at is not None:
            ratio *= share(at)
            at = above[at]
        values.append(math.sqrt(ratio))
    centre = max(values)
    for _ in range(60):
        upper = [v for v in values if v >= centre / 2]
        centre = sum(upper) / len(upper)
    content = [v >= centre / 2 - 1e-12 for v in values]
    size = lambda held, chosen=False: sum(len(lines[k][1]) for k in held if content[k] or not chosen)
    state = {}
    for e in order:
        held, own = [k for k in range(n) if inside(k, e)], [k for k in range(n) if lines[k][0] is e]
        mostly = held and 2 * size(held, True) >= size(held)
        up, in_main = above[e], e.tag == "article"
        while up is not None and not in_main:
            in_main, up = up.tag == "article", above[up]
        if state.get(above[e]):
            other = share(e) < 1 or (2 * sum(lines[k][2] for k in held) > size(held) and not in_main)
            state[e] = "out" if state[above[e]] == "out" or (other and not mostly) else "in"
        elif (own and 2 * size(own, True) >= size(own)) or (e.tag == "article" and mostly):
            state[e] = "in"
    kept = [state.get(x[0]) == "in" for x in lines]
    named = lambda at: 0 if at is None else (share(at) < 1) + named(above[at])
    for k in range(n - 2, -1, -1):
        if kept[k + 1] and lines[k][3] == "h1" and state.get(lines[k][0]) != "out" and named(lines[k][0]) == named(lines[k + 1][0]):
            kept[k] = True
    return "\n".join(x[1] for x, stays in zip(lines, kept if any(kept) else content, strict=True) if stays)


def random_page(rng: random.Random) -> ElementTree.Element:
    def fill(e: ElementTree.Element, depth: int, menu: bool = False) -> None:
        # An article inside a menu ends it, as its end tag is taken to be missing; so none is put there.
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.45:
                child = ElementTree.SubElement(e, rng.choice(["div", "div", "section", "nav", "aside", "ul", "footer", *["article"] * (not menu)]))
                if rng.random() < 0.2:
                    child.set("class", rng.choice(["comments", "sidebar", "story"]))
                fill(child, depth - 1, menu or child.tag == "nav")
            else:
                leaf = ElementTree.SubElement(e, "li" if e.tag == "ul" else rng.choice(["p", "p", "p", "h1"]))
                if e.tag in ("ul", "nav") or rng.random() < 0.15:
                    ElementTree.SubElement(leaf, "a", href="/x").text = "link" * rng.randint(1, 4)
                else:
                    leaf.text = "w" * rng.choice([3, 20, 90, 400])

    root = ElementTree.Element("body")
    fill(root, 4)
    return root


def test_pages_against_plain_rules():  # noqa: ANN201
    rng, several = random.Random(8), 0
    for _ in range(400):
        page = random_page(rng)
        want = plain_regions(page)
        assert html_text.main_text(ElementTree.tostring(page, encoding="unicode")) == want
        several += 0 < len(want) < sum(len(t) for t in page.itertext())
    assert several > 100


def test_pages_are_decided_by_the_clusters(monkeypatch):  # noqa: ANN001, ANN201
    pages = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()
    before = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "_threshold", lambda values: -math.inf)
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) > 0.9 * len(pages)


@pytest.mark.parametrize(
    ("page", "end"),
    [
        ("<article class='social-studies'>" + BODY + "<p>The end.</p></article>", "\nThe end."),
        ("<div>" + BODY + BODY + "<p>The end.</p></div>", "\nThe end."),
        ("<article>" + BODY + "<p>so <math><mi>x</mi></math> is <button>it</button></p></article>", "\nso x is it"),
        ("<form id=all><nav>menu <a>a</a></nav><article>" + BODY + "</article></form>", PROSE),
    ],
)
def test_pages_keep_what_belongs(page, end):  # noqa: ANN001, ANN201
    assert html_text.main_text(page).startswith(PROSE)
    assert html_text.main_text(page).endswith(end)


def test_malformed_pages_take_linear_time():  # noqa: ANN201
    def took(n: int) -> float:
        began = time.perf_counter()
        html_text.main_text("<div>" * n + "x" + "</section>" * n + "</div>" * n)
        return time.perf_counter() - began

    took(1000)
    assert min(took(16_000) for _ in range(3)) < 12 * min(took(4000) for _ in range(3))


def test_pages_query(spark):  # noqa: ANN001, ANN201
    got = {r["page_id"]: r for r in entries.queries()["op2_html_text"](spark, SF).collect()}
    t = pq.read_table(f"{SF}/pages.parquet")
    assert len(got) == t.num_rows
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got.values())


def test_pages_awkward(spark):  # noqa: ANN001, ANN201
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (1, "u", "<b" * 5000, "z")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract_text(pages).collect())[0] == ""
    assert html_text.extract_text(pages.limit(0)).count() == 0
    long = html_text.main_text("<article>" + "<p>words of a very long page, again and again</p>" * 40_000 + "</article>")
    assert long.count("\n") == 39_999


# Quality


def test_quality_on_labelled_documents(spark):  # noqa: ANN001, ANN201
    got = {r["doc_id"]: r["kept"] for r in entries.queries()["op3_quality"](spark, "/root/testdata/sf0.01").collect()}
    t = pq.read_table("/root/testdata/sf0.01/labels.parquet")
    labels = dict(zip(t["doc_id"].to_pylist(), t["quality"].to_pylist(), strict=True))
    assert sum(got[i] == bool(q) for i, q in labels.items()) / len(labels) > 0.97
    assert all(got[i] for i, q in labels.items() if q) or sum(not got[i] for i, q in labels.items() if q) / sum(labels.values()) < 0.01


def test_expectation_maximisation_recovers_accuracies():  # noqa: ANN201
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.85])
    votes = np.where((rng.random((20_000, 4)) < right) == truth[:, None], 1, -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.expectation_maximisation(patterns, counts.astype(float), 200)
    assert abs(share - 0.7) < 0.05
    assert np.abs(table[1, :, 2] - right).max() < 0.05


def test_quality_awkward(spark, awkward, empty):  # noqa: ANN001, ANN201
    table = spark.read.parquet(awkward)
    assert quality.score_quality(table).count() == len(AWKWARD)
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert quality.score_quality(spark.read.parquet(empty)).count() == 0


def test_quality_does_not_depend_on_partitions(spark):  # noqa: ANN001, ANN201
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = [{r["id"]: r["score"] for r in quality.score_quality(t, quality.fit(t, sample=150)).collect()} for t in (table, table.repartition(7))]
    assert got[0] == got[1]


def test_quality_is_decided_by_the_scorer(spark):  # noqa: ANN001, ANN201
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.fit(table)
    bad = quality.score_quality(table, model).where("not kept").count()
    none = quality.Model(model.share, model.table, np.zeros(quality.FEATURES), 0.0)
    assert bad > 0
    assert quality.score_quality(table, none).where("not kept").count() == 0


def test_quality_of_repetition_at_any_length():  # noqa: ANN201
    sentence = "this very sentence comes again and again without an end "
    assert all(quality.votes(quality.facts(sentence * n))[3] == -1 for n in (10, 100, 5000))
    assert quality.facts(" \n") is None


# Sharding


def test_shards_fit_and_cover(spark):  # noqa: ANN001, ANN201
    table = spark.createDataFrame([(i, "x" * (1 + i * 37 % 400)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.assign_shards(table, 5000, step=2).collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["bytes"]
    assert max(sizes.values()) <= 5000
    assert all(sizes[r["shard"]] == r["shard_bytes"] for r in rows)
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    # A bucket is split only if it was over the limit.
    for name in names:
        assert sum(v for k, v in sizes.items() if k.startswith(name[:-1])) > 5000


def test_shards_of_repeated_rows(spark):  # noqa: ANN001, ANN201
    table = spark.createDataFrame([(1, "y" * 100)] * 95 + [(2, "z" * 900), (None, None)], "doc_id long, text string")
    rows = sharding.assign_shards(table, 1000, step=30).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["bytes"]
    assert len(rows) == 97
    assert max(sizes.values()) <= 1000
    assert sharding.assign_shards(table.limit(0)).count() == 0


# Lines


def plain_line_dedup(texts: list[tuple[int, str]]) -> dict[int, str]:
    kept, before = {}, []
    for i, text in sorted(texts):
        out = []
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            if words and any(len(words & w) * 100 >= 80 * len(words | w) for w in before):
                pass
            else:
                out.append(line)
            if words:
                before.append(words)
        kept[i] = "\n".join(out)
    return kept


def test_written_shards(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = [(None, f"text {i} " * 9, "x", 1) for i in range(40)] + [(7, f"other {i} " * 9, "y", 2) for i in range(40)] + [(8, "same " * 20, "z", 3)] * 95
    path = str(tmp_path / "shards")
    sharding.write_shards(spark.createDataFrame(rows, SHAPE), path, byte_limit=1000)
    found = spark.read.parquet(path).select("doc_id", "text", "gone", "fp", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("folder")).collect()
    shown = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    assert sorted(map(shown, found)) == sorted(map(shown, rows))
    held = Counter()
    for r in found:
        held[r["folder"]] += len(r["text"])
    assert max(held.values()) <= 1000
    assert sum("." in f for f in held) == 10
    assert dict(spark.read.parquet(path).dtypes)["shard"] == "string"


def test_lines_against_brute_force(spark):  # noqa: ANN001, ANN201
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, rng.randint(1, 14)) for _ in range(40)]

    def line() -> str:
        picked = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if picked and rng.random() < 0.5:
                picked.pop(rng.randrange(len(picked)))
            else:
                picked.insert(rng.randint(0, len(picked)), rng.choice(words))
        return " ".join(w.upper() if rng.random() < 0.1 else w for w in picked)

    texts = [(i, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(texts)


@pytest.mark.parametrize("ids", [range(30), [i * (1 << 57) for i in range(-15, 15)]])
def test_lines_by_ids_close_and_far(spark, ids):  # noqa: ANN001, ANN201
    rng = random.Random(6)
    base = [[f"W{rng.randint(0, 200)}" for _ in range(rng.randint(3, 40))] for _ in range(25)]
    texts = [(i, "\n".join(rng.choice(" \t").join(rng.choice(base) + [f"x{i}"] * rng.randint(0, 1)) for _ in range(rng.randint(0, 6)))) for i in ids]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(texts)
    assert (line_dedup._first_id(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id") is None) == (len(range(min(ids), max(ids))) > 1 << 31)


def test_lines_of_repeated_ids_have_no_numbers_of_their_own(spark):  # noqa: ANN001, ANN201
    first = lambda ids: line_dedup._first_id(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id")
    assert first([3, 4, None]) == 3
    assert first([None]) == 0
    assert first([3, 3]) is None
    assert first([None, None]) is None


def test_lines_are_cut_once(spark, monkeypatch):  # noqa: ANN001, ANN201
    plans = []
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    table = spark.createDataFrame([(1, "a b c d e f\ng h")], "doc_id long, text string")
    line_dedup._words(spark.createDataFrame([(1, 1, 0)], "number long, id long, pos int"), table, "doc_id", "text")
    lines = line_dedup._lines(table, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count("split(") == 1
    assert not any("size(flatten" in plan for plan in plans)


def test_lines_awkward(spark, awkward, empty):  # noqa: ANN001, ANN201
    table = spark.read.parquet(awkward)
    got = line_dedup.dedup_lines(table, counts=("n", "m")).collect()
    assert len(got) == len(AWKWARD)
    assert [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["", ""]
    assert [r["text"] for r in got if r["doc_id"] == 6] == [" \n\t\n"]
    assert line_dedup.dedup_lines(spark.read.parquet(empty)).count() == 0


# BPE


def test_bpe_against_the_library(spark, docs, library):  # noqa: ANN001, ANN201
    got = {r["doc_id"]: r for r in entries.queries()["op6_bpe_codec"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_characters(vocabulary, library):  # noqa: ANN001, ANN201
    encoder, rng = bpe.Encoder(vocabulary), random.Random(1)
    odd = list("aé zZ09٣²½  \n\t\x0b\x1c\x85\xa0　_-×ªº“…漢ก‿€՘֋👍‍﻿ǅⅧ") + ["'s", "'ll", "<|endoftext|>", "!!", "\r\n", "ꟍ", "𖺠"]
    for _ in range(3000):
        text = "".join(rng.choices(odd, k=rng.randint(0, 14)))
        ids = list(bpe.ids_of(encoder.encode(text)))
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert vocabulary.decode(bpe.ids_of(encoder.encode(text))) == text
    for text in ("a" * 4000, "ab" * 2000 + " " * 500, "\n" * 2000, "=-" * 700):
        assert list(bpe.ids_of(encoder.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_lexicon_finds_its_words_and_no_others(tmp_path):  # noqa: ANN001, ANN201
    rng = random.Random(2)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(300)})
    path = tmp_path / "x.lexicon"
    path.write_bytes(lexicon.compile_words((w, [len(w), i]) for i, w in enumerate(words)))
    found = lexicon.Lexicon(str(path))
    assert found.words == len(words)
    assert found.states < sum(map(len, words))
    for i, w in enumerate(words):
        assert list(bpe.ids_of(found.get(w))) == [len(w), i]
    assert all(found.get(w) is None for w in (b"", b"abd", b"cccccccc") if w not in words)
    path.write_bytes(lexicon.compile_words([]))
    assert lexicon.Lexicon(str(path)).get(b"a") is None


def test_codec_round_trip(spark, awkward, empty):  # noqa: ANN001, ANN201
    encoded = bpe_codec.bpe_encode(spark.read.parquet(awkward))
    decoded = [r["text"] for r in bpe_codec.bpe_decode(encoded).collect()]
    assert sorted(decoded) == sorted(x[1] or "" for x in AWKWARD)
    assert bpe_codec.bpe_encode(spark.read.parquet(empty)).count() == 0


# SimHash


def plain_fingerprint(text: str, n: int) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict[int, int], reach: int) -> dict[int, int]:
    parent = {i: i for i in fps}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, docs):  # noqa: ANN001, ANN201
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entries.queries()["op7_simhash_dedup"](spark, SF).collect()}
    fps = {i: plain_fingerprint(t, 4) for i, t in docs.items()}
    roots = plain_components(fps, 4)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in docs}


@pytest.mark.parametrize("block", [4, 2048])
@pytest.mark.parametrize("reach", [0, 1, 3, 4])
def test_near_links_lose_none(spark, block, reach):  # noqa: ANN001, ANN201
    rng = random.Random(reach)
    fps, k = {}, 0
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps[k] = base ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))})
            k += 1
    by_fp = {}
    for i, fp in fps.items():
        by_fp.setdefault(fp, i)
    table = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, i) for fp, i in by_fp.items()], "fp long, rep long")
    roots = {r["node"]: r["root"] for r in components(simhash_dedup.near_links(table, reach, block)).collect()}
    want = plain_components({i: fp for fp, i in by_fp.items()}, reach)
    assert {i: roots.get(i, i) for i in want} == want


def test_components_of_a_path(spark):  # noqa: ANN001, ANN201
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 61)}
    assert components(edges.limit(0)).count() == 0


def test_simhash_awkward(spark, awkward, empty):  # noqa: ANN001, ANN201
    rows = simhash_dedup.simhash_groups(spark.read.parquet(awkward)).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["id"] in (3, 4, 6)} == {3}
    assert [r["component_id"] for r in rows if r["id"] is None] == [None]
    assert simhash_dedup.simhash_groups(spark.read.parquet(empty)).count() == 0


# Nearest neighbours


def test_neighbours_recall_and_scores(spark):  # noqa: ANN001, ANN201
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, v = np.array(t["vec_id"].to_pylist()), np.array(t["embedding"].to_pylist(), float)
    found = defaultdict(list)
    for r in entries.queries()["op8_ann"](spark, SF).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        scores = (v * v[q]).sum(1)
        others = ids != ids[q]
        best = ids[others][np.lexsort((ids[others], -scores[others]))][:20]
        got = found[ids[q]]
        hits += len(set(best) & {x for x, _ in got})
        assert len(got) == 20
        assert all(abs(dict(zip(ids, scores, strict=True))[x] - s) < 1e-12 for x, s in got)
    assert hits >= 0.9 * 20 * len(found)


def many_vectors(kind: str) -> np.ndarray:
    rng = np.random.default_rng(4)
    found = rng.standard_normal((20_000, 48))
    if kind == "clustered":
        found = rng.standard_normal((300, 48))[rng.integers(300, size=20_000)] + 0.3 * found
    if kind == "norms":
        found *= np.exp(rng.standard_normal((20_000, 1)))
    return found


@pytest.mark.parametrize(("kind", "probes"), [("gaussian", None), ("clustered", None), ("norms", None), ("clustered", 1)])
def test_neighbours_over_many_lists(spark, monkeypatch, kind, probes):  # noqa: ANN001, ANN201
    monkeypatch.setattr(ann, "CHUNK", 200)  # several chunks a list
    vectors = many_vectors(kind)
    if probes:
        # Far from all others and few: one list holds less than k of them, so the search goes on over all lists.
        vectors = vectors[:6000]
        vectors[:8] = vectors[:8] * 0.01 + 40
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(vectors)), "embedding": list(vectors)}))
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("id") % 200 == 0, 20, probes).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    met = 0
    for q in range(0, len(vectors), 200):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = np.argsort(-scores)[:20]
        assert len(got[q]) == 20
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got[q])
        met += len(set(best) & {i for i, _ in got[q]})
    assert met / (20 * len(got)) >= (0.95 if not probes else 0.3)


def test_neighbours_awkward(spark):  # noqa: ANN001, ANN201
    rows = [(i, [1.0, 0.0], 1) for i in range(60)] + [(100, [0.0, 1.0], 1), (120, None, 1), (140, [0.0, 0.0], 1), (160, [float("nan"), 1.0], 1), (180, [1.0, None], 1), (200, [1.0], 1), (None, [1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert set(got) == {0, 20, 40, 100}
    assert got[20] == [(i, 1.0) for i in (0, 1, 2, 3, 4)]
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)]
    assert got[100] == [(i, 0.0) for i in (0, 1, 2, 3, 4)]
    assert ann.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


# Personal data


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_against_plain_patterns():  # noqa: ANN201
    rng = random.Random(3)
    parts = [*"01234567895a.%+-@_ ()A", "@a.b", "4539 1488 0343 6467", "é", "255", "000255"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert [s[:3] for s in pii.spans_of(text) if s.kind in pii.BASE] == plain_spans(text)
    zeros = "0" * 5000 + ".1.1.1"
    assert pii.spans_of(zeros) == [("ip", 0, 5006, 0.6)]
    assert pii.spans_of("9" * 5000 + ".1.1.1") == []


def test_checksums_and_context():  # noqa: ANN201
    assert pii.luhn("4539148803436467")
    assert not pii.luhn("4539148803436468")
    kinds = lambda t: [s.kind for s in pii.spans_of(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB83 WEST 1234 5698 7654 32 now") == []
    secret = "463a598be7e762208ac6a4730a37634729cbd1d2"
    assert kinds(f'token = "{secret}"') == ["secret"]
    assert kinds(f"commit {secret} landed") == []
    assert kinds("ssn 123-45-6789") == ["identity"]
    assert kinds("amex 3782 822463 10005, not 3782 822463 10006") == ["short_card"]
    assert kinds("from 2001:db8:85a3:0:0:8a2e:370:7334 or at 10:20:30 in std::dec") == ["ipv6"]
    assert kinds("the server fe80::1 and a::b") == ["ipv6", "ipv6"]
    assert kinds("call (555) 123-4567") == ["national"]
    assert kinds("part 555-123-4567") == []
    assert kinds("+1 (826) 555-4081 161.17.88.162 x") == ["ip", "tel"]
    assert pii.redacted("a b@c.de f", pii.spans_of("a b@c.de f")) == "a [EMAIL] f"


def test_pii_query_and_redaction(spark, docs, awkward, empty):  # noqa: ANN001, ANN201
    for r in entries.queries()["op9_pii"](spark, SF).collect():
        want = plain_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    table = spark.read.parquet(awkward)
    changed = pii.redact(table)
    assert changed.columns == table.columns
    assert [r["text"] for r in changed.where("doc_id = 7").collect()] == ["[EMAIL] [IP] [PHONE]"]
    assert [r["text"] for r in changed.where("doc_id = 3").collect()] == [None]
    assert {r["kind"] for r in pii.find_pii(table).collect()} == {"email", "ip", "phone"}
    assert pii.find_pii(spark.read.parquet(empty)).count() == 0


# Packing


def test_packing_against_the_library(spark, docs, library):  # noqa: ANN001, ANN201
    rows = entries.queries()["op10_packing"](spark, SF).collect()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in docs.items()}
    pieces = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] & (r["length"] - 1) == 0
        assert r["length"] <= 1024
        assert (r["offset"], r["doc_tokens"]) == (0, len(ids[r["doc_id"]]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for i, all_ids in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(all_ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_lengths(n):  # noqa: ANN001, ANN201
    cut = packing.lengths(n)
    assert sum(cut) == n
    assert cut == sorted(cut, reverse=True)
    assert Counter(x for x in cut if x < 1024).most_common(1)[:1] in ([], [(cut[-1], 1)]) or max(Counter(x for x in cut if x < 1024).values()) == 1


def test_packing_awkward(spark, awkward, empty):  # noqa: ANN001, ANN201
    rows = packing.pack(spark.read.parquet(awkward)).collect()
    assert [(r["length"], r["ids"]) for r in rows if r["doc_id"] == 3] == [(1, bytearray(4))]
    assert packing.pack(spark.read.parquet(empty)).count() == 0


# Pipeline


def test_pipeline(spark, awkward, empty):  # noqa: ANN001, ANN201
    for path in (awkward, empty):
        docs = spark.read.parquet(path)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = after
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0


def test_near_stage_against_brute_force(spark):  # noqa: ANN001, ANN201
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 30))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy).title())
    texts += ["", " ", "one two", "One  two", None]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    near = 0
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                near += 1
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert near > 60
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], SHAPE)
    stayed = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, SF).collect()}
    assert stayed == {i for i, r in enumerate(root) if i == r}
