"""Phrase collocations from depth-limited count tries.

Texts are cut into shards of one language.  A shard counts its phrases as a trie, one depth at a time: a
node of a depth is its parent, one word shorter at the end, and its suffix link, one word shorter
at the start.  The shard writes each depth's counts in the order of the parents; the counts of all
shards are dealt out by ranges of that order and merged, equal nodes adding up.  What reaches the least
count becomes a node of the common trie, and each shard that has it is told so.  A phrase reaches
the count only if its parent and its suffix link do, so a shard goes on only where both are in the
trie, and at each depth its sequence shrinks to the places where a node still begins.

Walks from a node to the root pass its left parts, walks along suffix links its right parts.  So each
node takes the counts of its left parts from its parent and those of its right parts from its suffix
link, by two joins per depth.  A shard's state is bounded by ``SHARD`` words and one document;
the trie is never in one place.

Defined results
    null text counts as the empty text, a null language as ``und``; a text without words adds nothing;
    a language without a phrase that reaches the count gives no rows; repeated rows count as often
    as they occur; ties go by the phrase's bytes; an empty table gives an empty result; columns
    other than the text and the language are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm._shared import settled, table, text_or_empty

#: Words of a shard, after which it is closed; and bytes of texts that are split at once.
SHARD, CHUNK = 1 << 20, 1 << 20
#: Rows of shards' counts that are merged at once.
MERGED_ROWS = 1 << 18
#: No byte of UTF-8: stands for the end of a piece.
BREAK = b"\xff"
#: Bytes that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(0xFF if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A node's number: the depth above bit 58, the task above bit 36, and a count within the task.
DEPTH_BITS, TASK_BITS = 58, 36


class Shard:
    """Words of one language as numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[BREAK]
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, texts: list[bytes]) -> None:
        found = BREAK.join(texts).translate(LOWER).replace(BREAK, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.parts.append(np.zeros(1, np.int32))
        self.words += len(found)


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """shard, lang, the different words with their counts, and the sequence of their places; -1 ends a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, given = TaskContext.get().partitionId(), 0
        open_: dict[str, Shard] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal given
            shard = open_.pop(lang)
            given += 1
            ids = np.concatenate(shard.parts) - 1
            ids = ids[np.concatenate(([True], (ids[1:] >= 0) | (ids[:-1] >= 0)))]
            counts = np.bincount(ids[ids >= 0], minlength=len(shard.number) - 1)
            words = pa.array([w.decode() for w in list(shard.number)[1:]], pa.string())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
            arrays = [pa.array([(task << 32) + given], pa.int64()), pa.array([lang]), *lists, pa.array([ids.astype("<i4").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "lang", "words", "counts", "ids"])

        for batch in batches:
            waiting: dict[str, list[bytes]] = defaultdict(list)
            sizes: dict[str, int] = defaultdict(int)
            # One text at a time leaves Arrow's memory, so that a batch is not held a second time.
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = bytes(text.as_buffer())
                waiting[lang].append(body)
                sizes[lang] += len(body)
                if sizes[lang] >= CHUNK:
                    open_.setdefault(lang, Shard()).add(waiting.pop(lang))
                    sizes[lang] = 0
                    if open_[lang].words >= SHARD:
                        yield closed(lang)
            for lang, texts in waiting.items():
                open_.setdefault(lang, Shard()).add(texts)
                if open_[lang].words >= SHARD:
                    yield closed(lang)
        for lang in list(open_):
            yield closed(lang)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "shard long, lang string, words array<string>, counts array<long>, ids binary")


def _kept(ids: np.ndarray) -> np.ndarray:
    """A sequence without its repeated ends: each place that begins no node once between those that do."""
    here = ids >= 0
    return ids[here | np.concatenate(([False], here[:-1]))]


STATE = "shard long, ids binary, nodes binary"


def _state(shard: int, ids: np.ndarray, nodes: np.ndarray) -> pa.Table:
    row = {"shard": [shard], "ids": [_kept(ids).astype("<i4").tobytes()], "nodes": [nodes.astype("<i8").tobytes()]}
    return pa.table(row, pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("nodes", pa.binary())]))


def _read(row: pa.Table | pa.RecordBatch, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"][at].as_py(), "<i4"), np.frombuffer(row["nodes"][at].as_py(), "<i8")


def _packed(shard: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Each shard with its part of the columns, one after another."""
    order = np.argsort(shard, kind="stable")
    by, held = shard[order], np.stack(columns)[:, order].astype("<i8")
    starts = np.nonzero(np.concatenate(([True], by[1:] != by[:-1])))[0].tolist() if len(by) else []
    return [(int(by[a]), held[:, a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(by)], strict=False)]


def _unpacked(told: pa.Table, columns: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, "<i8").reshape(columns, -1) for b in told["told"].to_pylist()], axis=1)


def _with_words(shard: pa.Table, told: pa.Table) -> pa.Table:
    """The state of a shard after depth one; ``told`` (place, node): its words in the trie."""
    if not told.num_rows or not shard.num_rows:
        return _state(0, np.zeros(0, np.int32), np.zeros(0, np.int64)).slice(0, 0)
    ids = np.frombuffer(shard["ids"][0].as_py(), "<i4")
    place, node = _unpacked(told, 2)
    order = np.argsort(node)
    now = np.full(int(max(ids.max(initial=-1), place.max())) + 2, -1, np.int32)  # the last stays -1, for the ends
    now[place[order]] = np.arange(len(order))
    return _state(shard["shard"][0].as_py(), now[ids], node[order])


def _pairs(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a node and its right neighbour both begin, and the two as one number."""
    at = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
    return at, ids[at].astype(np.int64) * width + ids[at + 1]


COUNTS = "p long, s long, c long, shard long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's nodes one deeper than its state, in order: parent, suffix link and count."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, nodes = _read(batch, row)
            key, count = np.unique(_pairs(ids, len(nodes))[1], return_counts=True)
            arrays = [nodes[key // max(len(nodes), 1)], nodes[key % max(len(nodes), 1)], count.astype(np.int64), np.full(len(key), batch["shard"][row].as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["p", "s", "c", "shard"])


def _merge(least: int, depth: int, key: tuple[str, str], more: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the counts c of rows of equal ``key``, which come one after another.  Those that reach ``least`` are given as
    nodes, and each shard that has some is told so: the columns ``more`` (without them the key) and the node, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = (depth << DEPTH_BITS) + (TaskContext.get().partitionId() << TASK_BITS), None

        def closed(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal node
            total = np.add.reduceat(rows["c"].to_numpy(), starts)
            own = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [rows.num_rows]))))
            frequent = total >= least
            number = node + np.cumsum(frequent)
            node += int(frequent.sum())
            heads, told = np.nonzero(frequent)[0], np.nonzero(frequent[own])[0]
            at = rows.take(pa.array(starts[heads]))
            packed = _packed(rows["shard"].to_numpy()[told], *(rows[c].to_numpy()[told] for c in more or key), number[own[told]])
            n, m = len(heads), len(packed)
            columns = [pa.concat_arrays([at[k].combine_chunks(), pa.nulls(m, at[k].type)]) for k in key]
            columns += [pa.concat_arrays([pa.array(x[heads], pa.int64()), pa.nulls(m, pa.int64())]) for x in (total, number)]
            columns += [pa.concat_arrays([pa.nulls(n, kind), pa.array([x[i] for x in packed], kind)]) for i, kind in enumerate((pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "a", "node", "shard", "told"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # Enough rows at once that a shard is told of many nodes in one row.
            if held.num_rows < MERGED_ROWS:
                continue
            starts = _starts(held, key)
            if starts[-1]:
                yield from closed(held.slice(0, int(starts[-1])), starts[:-1])
                held = held.slice(int(starts[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield from closed(held, _starts(held, key))

    return run


def _starts(rows: pa.Table, key: tuple[str, str]) -> np.ndarray:
    """Where another key begins."""
    columns = [rows[k].combine_chunks() for k in key]
    other = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns]
    return np.nonzero(np.concatenate(([True], other[0] | other[1])))[0]


def _deeper(shard: pa.Table, told: pa.Table) -> pa.Table:
    """The state of a shard one deeper; ``told`` (p, s, node): its nodes of that depth in the trie."""
    if not told.num_rows or not shard.num_rows:
        return _state(0, np.zeros(0, np.int32), np.zeros(0, np.int64)).slice(0, 0)
    ids, nodes = _read(shard)
    p, s, node = _unpacked(told, 3)
    known = np.searchsorted(nodes, p) * len(nodes) + np.searchsorted(nodes, s)
    order = np.argsort(known)
    known, node = known[order], node[order]
    at, key = _pairs(ids, len(nodes))
    found = np.minimum(np.searchsorted(known, key), len(known) - 1)
    now = np.full(len(ids), -1, np.int32)
    now[at] = np.where(known[found] == key, found, -1)
    return _state(shard["shard"][0].as_py(), now, node)


def phrase_trie(docs: DataFrame, least: int, longest: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The trie of phrases that occur ``least`` times or more, and n (words) of each lang.

    The trie's columns: node, parent and link (null at depth one), lang, depth, words, a (count), and the counts of
    its left and right parts by their number of words, as lefts and rights.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(shards(docs, text_col, lang_col), "shards")
    words = cut.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x"))
    words = words.select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"), "shard", F.col("place").cast("long").alias("place"))
    totals = cut.select("lang", F.explode("counts").alias("c")).groupBy("lang").agg(F.sum("c").alias("n"))
    ordered = words.repartitionByRange(parts, "lang", "word").sortWithinPartitions("lang", "word")
    merged = settled(ordered.mapInArrow(_merge(least, 1, ("lang", "word"), ("place",)), "lang string, word string, a long, node long, shard long, told binary"), "merged")
    first, told = merged.where("shard is null"), merged.where("shard is not null").select(F.col("shard").alias("own"), "told")
    state = settled(cut.select("shard", "ids").groupBy("shard").cogroup(told.groupBy("own")).applyInArrow(_with_words, STATE), "state")
    no = F.lit(None).cast("long")
    trie = first.select("node", no.alias("parent"), no.alias("link"), "lang", F.lit(1).alias("depth"), F.array("word").alias("words"), "a", F.array("a").alias("lefts"), F.array("a").alias("rights"))
    depths = [trie]
    for depth in range(2, longest + 1):
        counts = state.mapInArrow(_counted, COUNTS).repartitionByRange(parts, "p", "s").sortWithinPartitions("p", "s")
        merged = settled(counts.mapInArrow(_merge(least, depth, ("p", "s"), ()), "p long, s long, a long, node long, shard long, told binary"), "merged")
        new = merged.where("shard is null").select("node", F.col("p").alias("parent"), F.col("s").alias("link"), "a")
        above = depths[-1]
        left = above.select(F.col("node").alias("parent"), "lang", F.col("words").alias("start"), F.col("lefts").alias("over"))
        right = above.select(F.col("node").alias("link"), F.element_at("words", -1).alias("end"), F.col("rights").alias("after"))
        trie = new.join(left, "parent").join(right, "link").select(
            "node", "parent", "link", "lang", F.lit(depth).alias("depth"), F.concat("start", F.array("end")).alias("words"), "a",
            F.concat("over", F.array("a")).alias("lefts"), F.concat("after", F.array("a")).alias("rights"),
        )
        depths.append(settled(trie, "depth"))
        if depth < longest:
            told = merged.where("shard is not null").select(F.col("shard").alias("own"), "told")
            state = settled(state.groupBy("shard").cogroup(told.groupBy("own")).applyInArrow(_deeper, STATE), "state")
    whole = depths[0]
    for more in depths[1:]:
        whole = whole.unionByName(more)
    return whole, totals


def _lowest(a: Column, n: Column, lefts: Column, rights: Column, depth: Column) -> Column:
    """Of all cuts of a phrase the one with the lowest score, ties to the shortest left part: score, k, l, r."""
    wide = lambda x: x.cast("decimal(38,0)")

    def at(k: Column) -> Column:
        left, right = F.element_at(lefts, k), F.element_at(rights, depth - k)
        over = F.lit(1000).cast("decimal(4,0)") * wide(a).cast("decimal(15,0)") * wide(n).cast("decimal(17,0)")
        under = wide(left).cast("decimal(18,0)") * wide(right).cast("decimal(18,0)")
        return F.struct(F.call_function("div", over, under).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), depth - 1), at))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorbed: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first ``top`` phrases of two to ``longest`` words that
    occur ``least`` times or more; a phrase inside a longer one that has ``absorbed`` per cent of its occurrences goes."""
    trie, totals = phrase_trie(docs, least, longest, text_col, lang_col)
    # Every longer phrase around one holds one that is a word longer and occurs as often at least.
    around = trie.where("depth > 2").select(F.explode(F.array("parent", "link")).alias("node"), F.col("a").alias("longer"))
    most = around.groupBy("node").agg(F.max("longer").alias("longer"))
    held = trie.where("depth > 1").join(most, "node", "left").where(f"longer is null or 100 * longer < {absorbed} * a")
    scored = held.join(totals, "lang").withColumn("cut", _lowest(F.col("a"), F.col("n"), F.col("lefts"), F.col("rights"), F.col("depth")))
    found = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), g AS (
    SELECT lang, d, w[i:i + d - 1] AS g FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM w, range(1, {longest + 1}) t(d))
), f AS (
    SELECT lang, d, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {least}
), n AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), c AS (
    SELECT * FROM f WHERE d > 1
), inside AS (
    SELECT DISTINCT s.lang, s.g FROM c s JOIN (SELECT lang, d, a, g, unnest(range(1, d)) AS m FROM c WHERE d > 2) b
        ON s.lang = b.lang AND s.d = b.m AND b.a >= s.a AND s.d < b.d AND list_contains(list_transform(range(1, b.d - b.m + 2), lambda i: b.g[i:i + b.m - 1]), s.g)
), cuts AS (
    SELECT c.lang, c.g, c.a, k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, d)) AS k FROM c) c JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:c.d]
), best AS (
    SELECT * FROM cuts ANTI JOIN inside USING (lang, g) QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
    array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= {top}"""


SQL = sql()
