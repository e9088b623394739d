"""N-gram Jaccard join of documents by a grouped prefix join, exact up to 64-bit hashes of the shingles.

A document is the set of its word shingles.  Tokens (hashed shingles) are ordered by the number of
documents that hold them, then by value; two sets that reach the similarity share a token among
the first ``n - ceil(similarity * n) + 1`` of either.  A token that no other document holds cannot be that one, so of a
prefix only the tokens that others hold are kept.  Documents of one size with the same such prefix form a group; groups meet under
their tokens, are filtered by size, by the place of the token and by a bitmap, and only the pairs that are left are
expanded to members and verified.

Counting every token of every document would shuffle the whole corpus, so a first step finds who can
take part: under the order of hash values, sets that reach the similarity share a known number of tokens at the start of that
order, and a document whose start holds fewer shared tokens has no partner.  Tokens travel as packed arrays, equal tokens of a
chunk of documents once, so a token that a third of all documents hold is sent once a chunk.

What is asked for is the component of each document.  So a group is first compared with the group it shares most tokens with
among the firsts of its tokens, and from then on all pairs of different components are looked at: under each
token the first few of each component, then more, until no token holds an untested pair of different components.  No pair that can join two components is left out.

Defined results
    null text counts as the empty text; a document without words has size 0, is linked with nothing and is its own component;
    fewer words than a shingle make one shingle; texts of equal words are copies of one entry; a row with a null id takes
    the component of the rows of equal words, and null if none has an id, and links nothing by itself; repeated rows are copies;
    an empty table gives an empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm._shared import settled, table, text_or_empty
from lodestrata.llm.components import components

SEED = 42
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Tokens of a chunk of documents, after which it is closed; and tokens counted in one group.
CHUNK, BUCKET = 1 << 20, 1 << 20
#: Of the first step, the share of a set by which its start is longer than needed to share one token, in per cent.
MORE = 10
#: Bytes kept of a token in the first step, where a chance equality only lets a document through, and in the second.
NARROW, WIDE = 6, 8
#: Longs of the bitmap of a set, and of what is folded of it for the lists.
BITMAP, FOLDED = 8, 2
#: Members of a component compared under a token in the first round, and the growth of that number.
FIRST, GROWTH = 2, 1024


def normal(text: str) -> bytes:
    """The words of a text, lower-cased in ASCII, with single spaces."""
    return b" ".join(text.encode().translate(ASCII_LOWER).split())


def tokens(joined: bytes, words: int) -> np.ndarray:
    """The different shingles of a normal text, hashed, in order of their values."""
    parts = joined.split(b" ") if joined else []
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) + np.arange(len(parts))
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def _pack(tokens: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()


def _unpack(blob: bytes, width: int) -> np.ndarray:
    rows = np.zeros((len(blob) // width, 8), np.uint8)
    rows[:, 8 - width :] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return rows.view("<u8").reshape(-1)


def _share(n: int, percent: int) -> int:
    """The least whole number of at least ``percent`` per cent of n."""
    return -(-percent * n // 100)


def start_of(n: int, percent: int) -> int:
    """Tokens of a set that the first step looks at."""
    return min(n, n - _share(n, percent) + _share(n, MORE))


def start_needs(n: int, percent: int) -> int:
    """How many of them at least a partner's start holds: the partner has ``_share(n, percent)`` tokens or more."""
    return _share(_share(n, percent), MORE)


CHUNKS = "chunk long, ids array<long>, keys array<long>, digests array<binary>, ns array<long>, tokens binary, sizes binary, total long"


def _chunks(docs: DataFrame, words: int, size: Callable[[int], int], width: int) -> DataFrame:
    """``docs`` (id, key, text) in chunks: ids, keys, digests and set sizes of the documents, and the first
    ``size(n)`` tokens of each, of texts of equal words in one task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, given, seen = TaskContext.get().partitionId(), 0, set()
        ids, keys, digests, ns, parts = [], [], [], [], []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal given, held
            given += 1
            lists = [pa.array([x], kind) for x, kind in ((ids, pa.list_(pa.int64())), (keys, pa.list_(pa.int64())), (digests, pa.list_(pa.binary())), (ns, pa.list_(pa.int64())))]
            flat = _pack(np.concatenate(parts), width)
            sizes = np.array(list(map(len, parts)), "<i4").tobytes()
            arrays = [pa.array([(task << 32) + given], pa.int64()), *lists, pa.array([flat], pa.binary()), pa.array([sizes], pa.binary()), pa.array([held], pa.int64())]
            for x in (ids, keys, digests, ns, parts):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "ids", "keys", "digests", "ns", "tokens", "sizes", "total"])

        for batch in batches:
            for i, key, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                joined = normal(text)
                digest = xxhash.xxh3_128_digest(joined) if joined else None
                found = tokens(joined, words)
                ids.append(i)
                keys.append(key)
                digests.append(digest)
                ns.append(len(found))
                # A row without an id has nothing to stand for it, and copies have been entered.
                fresh = digest is not None and i is not None and digest not in seen
                parts.append(found[: size(len(found))] if fresh else found[:0])
                if fresh:
                    seen.add(digest)
                held += len(parts[-1])
                if held >= CHUNK or len(ids) >= 1 << 16:
                    yield closed()
        if ids:
            yield closed()

    return docs.mapInArrow(run, CHUNKS)


def _postings(buckets: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch["chunk"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                found, count = np.unique(_unpack(blob, width), return_counts=True)
                bucket = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                starts = np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[0] if len(found) else np.zeros(0, int)
                ends = [*starts[1:].tolist(), len(found)]
                spans = list(zip(starts.tolist(), ends, strict=False))
                arrays = [
                    pa.array(bucket[starts].astype(np.int64)), pa.array(np.full(len(starts), chunk), pa.int64()),
                    pa.array([_pack(found[a:b], width) for a, b in spans], pa.binary()), pa.array([count[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "own", "found", "counts"])

    return run


def _totals(width: int) -> Callable[[pa.Table], pa.Table]:
    """Of the postings of a bucket, for each chunk its tokens that more than one document holds, with their number."""

    def run(group: pa.Table) -> pa.Table:
        blobs = group["found"].to_pylist()
        sizes = [len(b) // width for b in blobs]
        found = _unpack(b"".join(blobs), width)
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in group["counts"].to_pylist()])
        order = np.argsort(found, kind="stable")
        ordered = found[order]
        starts = np.nonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))[0]
        sums = np.add.reduceat(counts[order].astype(np.int64), starts)
        total = np.empty(len(found), np.int64)
        total[order] = np.repeat(sums, np.diff(np.concatenate((starts, [len(found)]))))
        ends = np.cumsum(sizes)
        more, out = total > 1, []
        for own, a, b in zip(group["own"].to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            if (here := more[a:b]).any():
                out.append((own, _pack(found[a:b][here], width), np.minimum(total[a:b][here], 0xFFFFFFFF).astype("<u4").tobytes()))
        own, found_, totals = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"own": pa.array(own, pa.int64()), "found": pa.array(found_, pa.binary()), "totals": pa.array(totals, pa.binary())})

    return run


PICKED = "digest binary, n long, shared array<long>, bitmap array<long>"


def _picked(needs: Callable[[int], int], width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of a chunk that hold as many shared tokens as they need, with these in order if they are whole."""
    whole = width == WIDE

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        digests, ns, lists, maps = [], [], [], []
        if chunk.num_rows and told.num_rows:
            known = _unpack(b"".join(told["found"].to_pylist()), width)
            total = np.concatenate([np.frombuffer(b, "<u4") for b in told["totals"].to_pylist()])
            by = np.argsort(known)
            known, total = known[by], total[by]
            mine, sizes = _unpack(chunk["tokens"][0].as_py(), width), np.frombuffer(chunk["sizes"][0].as_py(), "<i4")
            own = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = known[at] == mine
            mine, own, total = mine[hit], own[hit], total[at[hit]]
            order = np.lexsort((mine, total, own))
            mine, own = mine[order], own[order]
            edges = np.searchsorted(own, np.arange(len(sizes) + 1))
            all_digests, all_ns = chunk["digests"][0].as_py(), chunk["ns"][0].as_py()
            for doc in np.nonzero(np.diff(edges))[0].tolist():
                a, b = int(edges[doc]), int(edges[doc + 1])
                if b - a < needs(all_ns[doc]):
                    continue
                digests.append(all_digests[doc])
                ns.append(all_ns[doc])
                lists.append(mine[a:b].view(np.int64) if whole else None)
                if whole:
                    odd = np.bincount((mine[a:b] >> np.uint64(55)).astype(np.int64), minlength=64 * BITMAP) & 1
                    maps.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
                else:
                    maps.append(None)
        longs = pa.list_(pa.int64())
        arrays = [pa.array(digests, pa.binary()), pa.array(ns, pa.int64()), pa.array(lists, longs), pa.array(maps, longs)]
        return pa.Table.from_arrays(arrays, names=["digest", "n", "shared", "bitmap"])

    return run


def _shared(chunks: DataFrame, needs: Callable[[int], int], width: int) -> DataFrame:
    """digest, n, and the tokens that other documents hold too, rarest first, of the documents that have enough of them."""
    spark = chunks.sparkSession
    total = chunks.agg(F.sum("total")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1)
    postings = chunks.select("chunk", "tokens").mapInArrow(_postings(buckets, width), "bucket long, own long, found binary, counts binary")
    told = postings.groupBy("bucket").applyInArrow(_totals(width), "own long, found binary, totals binary")
    return chunks.select("chunk", "digests", "ns", "tokens", "sizes").groupBy("chunk").cogroup(told.groupBy("own")).applyInArrow(_picked(needs, width), PICKED)


class _Join:
    """The grouped prefix join over ``entries`` (node, n, shared, bitmap)."""

    def __init__(self, entries: DataFrame, percent: int) -> None:
        self.entries, self.percent = entries, percent
        spark = entries.sparkSession
        least = F.expr(f"(n * {percent} + 99) div 100")
        head = F.slice("shared", F.lit(1), F.size("shared") - least + 1)
        named = entries.select("node", "n", F.size("shared").alias("s"), head.alias("head"), "bitmap").withColumn("same", F.sha2(F.array_join("head", ","), 256))
        groups = named.groupBy("n", "s", "same").agg(F.min("node").alias("gid"))
        self.members = settled(named.select("node", "n", "s", "same").join(groups, ["n", "s", "same"]).select("node", "gid"), "members")
        firsts = named.join(groups.select(F.col("gid").alias("node")), "node", "left_semi")
        fold = [F.aggregate(F.slice("bitmap", 1 + k * (BITMAP // FOLDED), BITMAP // FOLDED), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)).alias(f"f{k}") for k in range(FOLDED)]
        listed = firsts.select(F.col("node").alias("gid"), "n", "s", "head", *fold, F.posexplode("head").alias("i", "token"))
        listed = listed.withColumn("prev", F.get("head", F.col("i") - 1)).drop("head")
        # A token of one group brings nobody together.
        wide = listed.groupBy("token").agg(F.min("gid").alias("a"), F.max("gid").alias("b")).where("a < b").select("token")
        self.lists = settled(listed.join(wide, "token", "left_semi"), "lists")
        self.links = spark.createDataFrame([], "u long, v long")

    def link(self, pairs: DataFrame) -> None:
        """Verify ``pairs`` (u, v) and add those that reach the similarity."""
        left, right = (self.entries.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"t{x}"), F.col("bitmap").alias(f"b{x}")) for x in ("u", "v"))
        sizes = self.entries.select("node", "n", F.size("shared").alias("s"), "bitmap")
        # Sizes and bitmaps first: they are narrow, and their bound lets few pairs through that fail.
        narrow = pairs.distinct()
        for x in ("u", "v"):
            narrow = narrow.join(sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"), F.col("bitmap").alias(f"b{x}")), x)
        need = F.expr(f"((nu + nv) * {self.percent} + {99 + self.percent}) div {100 + self.percent}")
        apart = sum((F.bit_count(F.col("bu")[k].bitwiseXOR(F.col("bv")[k])) for k in range(BITMAP)), F.lit(0))
        able = narrow.where((F.least("su", "sv") >= need) & (apart <= F.col("su") + F.col("sv") - 2 * need)).select("u", "v")
        both = able.join(left.drop("bu"), "u").join(right.drop("bv"), "v")
        found = both.where(F.size(F.array_intersect("tu", "tv")) * (100 + self.percent) >= self.percent * (F.col("nu") + F.col("nv")))
        self.links = settled(self.links.unionByName(found.select("u", "v")), "ngram_links")

    def spread(self) -> None:
        """Give every member its component as the links now make it, and keep the lists that hold several."""
        roots = settled(components(self.links), "roots")
        # The stars span what the links did.
        self.links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        self.comps = settled(self.members.join(roots, "node", "left").select("node", "gid", F.coalesce("root", "node").alias("comp")), "comps")
        self.subs = settled(self.comps.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("size")), "subs")
        at = self.lists.select("token", "gid").join(self.subs.select("gid", "comp"), "gid")
        several = at.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
        self.lists = settled(self.lists.join(several, "token", "left_semi"), "lists")

    def nearest(self) -> DataFrame:
        """Members with the first of their group, and each group with the one it shares most tokens with among the firsts of its tokens."""
        own = self.members.where("node <> gid").select(F.col("gid").alias("u"), F.col("node").alias("v"))
        return own.unionByName(self._best(self.lists.select("token", "gid", F.col("gid").alias("comp"))))

    def _best(self, rows: DataFrame) -> DataFrame:
        first = rows.groupBy("token").agg(F.min(F.struct("comp", "gid")).alias("f"))
        met = rows.join(first, "token").where("comp <> f.comp").groupBy("comp", F.col("f.comp").alias("to")).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("f.gid", F.col("gid").alias("own"))).alias("p"))
        best = met.groupBy("comp").agg(F.max_by("p", F.struct("c", (-F.col("to")).alias("t"))).alias("p"))
        return best.select(F.col("p.gid").alias("u"), F.col("p.own").alias("v"))

    def compare(self, most: int) -> int:
        """Compare, under each token and in each group, up to ``most`` of each component with those of others.

        Returns how many of one component stand under a token that holds several.
        """
        inside = self.subs.groupBy("gid").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("size").alias("size")).where("a < b")
        lists = settled(self.lists.join(self.subs, "gid"), "open_lists")
        under = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size")).agg(F.max(F.greatest("c", "size"))).first()[0] or 0
        bound = max(under, inside.agg(F.max("size")).first()[0] or 0)
        if not bound:
            return 0
        order = Window.partitionBy("token", "comp").orderBy("gid")
        few = lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        x, y = (few.select("token", *(F.col(c).alias(f"{c}_{end}") for c in ("gid", "comp", "n", "s", "i", "prev", *(f"f{k}" for k in range(FOLDED))))) for end in "xy")
        apart = sum((F.bit_count(F.col(f"f{k}_x").bitwiseXOR(F.col(f"f{k}_y"))) for k in range(FOLDED)), F.lit(0))
        need = F.expr(f"((n_x + n_y) * {self.percent} + {99 + self.percent}) div {100 + self.percent}")
        fits = (
            (F.col("comp_x") < F.col("comp_y")) & (F.col("gid_x") != F.col("gid_y"))
            # Pairs that share the token before this one meet there.
            & (F.col("prev_x").isNull() | F.col("prev_y").isNull() | (F.col("prev_x") != F.col("prev_y")))
            & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * self.percent)
            & (F.least(F.col("s_x") - F.col("i_x"), F.col("s_y") - F.col("i_y")) >= need)
            & (apart <= F.col("s_x") + F.col("s_y") - 2 * need)
        )
        pairs = x.hint("merge").join(y.hint("merge"), "token").where(fits).select("gid_x", "comp_x", "gid_y", "comp_y").distinct()
        own = self.subs.join(inside.select("gid"), "gid", "left_semi")
        same = own.select("gid", F.col("comp").alias("comp_x")).join(own.select("gid", F.col("comp").alias("comp_y")), "gid").where("comp_x < comp_y")
        pairs = pairs.unionByName(same.select(F.col("gid").alias("gid_x"), "comp_x", F.col("gid").alias("gid_y"), "comp_y"))
        ranked = self.comps.withColumn("place", F.row_number().over(Window.partitionBy("gid", "comp").orderBy("node"))).where(F.col("place") <= most)
        side = lambda end, name: ranked.select(F.col("gid").alias(f"gid_{end}"), F.col("comp").alias(f"comp_{end}"), F.col("node").alias(name))
        self.link(pairs.join(side("x", "u"), ["gid_x", "comp_x"]).join(side("y", "v"), ["gid_y", "comp_y"]).select("u", "v"))
        return bound

    def run(self) -> DataFrame:
        """node and root of the nodes that are not the least of their component."""
        self.link(self.nearest())
        self.spread()
        most = FIRST
        while self.compare(most) > most:
            self.spread()
            most *= GROWTH
        return components(self.links)


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (different shingles) and component_id (the least id reachable by links) of each row.

    Two documents link when 100 times their shared shingles are at least ``percent`` times those of either.
    """
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    chunks = settled(_chunks(source, words, lambda n: start_of(n, percent), NARROW), "chunks")
    rows = chunks.select(F.inline(F.arrays_zip("ids", "keys", "digests", "ns"))).select(F.col("ids").alias("id"), F.col("keys").alias("key"), F.col("digests").alias("digest"), F.col("ns").alias("n"))
    able = settled(_shared(chunks, lambda n: start_needs(n, percent), NARROW).select("digest").distinct(), "able")
    stands = rows.where("id is not null").join(able, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("id", "key")).alias("x"))
    stands = settled(stands.select("digest", "x.id", "x.key"), "stands")
    # By merging at every size: what stands in grows with the corpus, and so a plan for small tables would not show what large ones cost.
    again = source.join(stands.select("id", "key").hint("merge"), ["id", "key"], "left_semi").select("id", "key", "text")
    whole = settled(_chunks(again, words, lambda n: n, WIDE), "whole")
    found = _shared(whole, lambda n: _share(n, percent), WIDE).dropDuplicates(["digest"])
    entries = settled(found.join(stands.select("digest", F.col("id").alias("rep")), "digest").withColumn("node", F.monotonically_increasing_id()), "entries")
    roots = _Join(entries, percent).run()
    led = entries.select("node", "digest", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = led.groupBy("root").agg(F.min("rep").alias("least"))
    moved = led.join(least, "root").select("digest", "least")
    copies = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1 and least is not null")
    named = copies.select("digest", "least").join(moved.select("digest"), "digest", "left_anti").unionByName(moved)
    return rows.join(named.hint("merge"), "digest", "left").select("id", "n", F.coalesce("least", "id").alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
