"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

Fingerprints are cut into segments of two bits; the count of set bits per segment embeds a
fingerprint in a grid.  The Manhattan distance of two embeddings never exceeds the Hamming distance
of the fingerprints, so pairs within ``reach`` bits lie within ``reach`` grid steps.  The segments
fall into two halves; in one of them the distance is at most half of ``reach``.  For a reach of up
to four that is two steps, and two points within two steps share a point that is at most one step
from either.  So every fingerprint is entered, per half, in its own cell and the cells one step
away, and every pair within reach meets in some cell.  Pairs that meet are verified by the exact
Hamming distance.

Equal fingerprints are one entry.  Within a cell, links become a forest (each entry to the first
of its tree), never all pairs.  Cells are read in sorted runs; a run longer than ``block`` is cut
into blocks, and pairs of blocks are compared in tasks of their own.  Links, joined into connected
components, never reach the driver.

Defined results
    null text counts as the empty text; texts without words have fingerprint zero and link like any
    other; texts of fewer words than a shingle hash as one shingle; a row with a null id takes
    the component of the rows that share its fingerprint, and null if none has an id; repeated rows
    link to each other; an empty table gives an empty result; columns other than the id and the
    text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import settled, table, text_or_empty
from lodestrata.llm.components import components

SEED = 42
BLOCK = 2048
#: Cells of up to so many entries are looked through together.
SMALL = 12
#: The low bit of each two-bit segment of a half.
LOW_BITS = 0x55555555


def fingerprint(text: str, words: int) -> int:
    """The SimHash of a text's word shingles, as an unsigned number.

    A bit is set if it is in more than half of the shingles' XXH64 values.
    """
    parts = text.encode().translate(ASCII_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) + np.arange(len(parts))
    starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.uint64)
    spans = list(zip(starts, ends[words - 1 :].tolist(), strict=True))
    for k in range(0, len(spans), 8192):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[k : k + 8192]], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return sum(1 << i for i in np.nonzero(2 * set_bits > len(spans))[0].tolist())


ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (the 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _cells(fp: Column) -> Column:
    """Of both halves, the cell of ``fp`` and those one step away, as longs; the half is bit 32."""
    sides = []
    for half in (0, 1):
        bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        low = F.lit(LOW_BITS).cast("long")
        # Two bits of the cell hold the count of set bits of one segment: 0, 1 or 2.
        counts = bits.bitwiseAND(low) + F.shiftrightunsigned(bits, 1).bitwiseAND(low)
        cell = counts + F.lit(half << 32)
        steps = F.array(*(F.when(F.shiftrightunsigned(counts, s).bitwiseAND(F.lit(3)) < 2, cell + F.lit(1 << s)) for s in range(0, 32, 2)))
        back = F.array(*(F.when(F.shiftrightunsigned(counts, s).bitwiseAND(F.lit(3)) > 0, cell - F.lit(1 << s)) for s in range(0, 32, 2)))
        sides += [F.array(cell), steps, back]
    return F.array_compact(F.concat(*sides))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fp: np.ndarray, rep: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``reach`` among the entries of one cell as a forest: (entry, first of its tree)."""
    n = len(fp)
    if n == 2:
        near = _bits(fp[:1] ^ fp[1:]) <= reach
        return rep[1:][near], rep[:1][near]
    tree, left = np.arange(n), []
    todo = np.ones(n, bool)
    for seed in range(n):
        if not todo[seed]:
            continue
        # Grow the tree of ``seed``: each entry looks once at those that no tree has yet.
        todo[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            left = np.nonzero(todo)[0]
            if not len(left):
                break
            found = left[_bits(fp[left] ^ fp[at]) <= reach]
            todo[found] = False
            tree[found] = seed
            queue += found.tolist()
    linked = np.nonzero(tree != np.arange(n))[0]
    return rep[linked], rep[tree[linked]]


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cell", pa.int64()), ("fp", pa.int64())])


def _links_by_run(reach: int, block: int):  # noqa: ANN202
    """Reads rows sorted by cell; gives links (u, v), and the members (cell, fp, u) of runs over ``block``."""

    def give(u: np.ndarray, v: np.ndarray | None = None, cell: np.ndarray | None = None, fp: np.ndarray | None = None) -> pa.RecordBatch:
        arrays = [pa.nulls(len(u), pa.int64()) if a is None else pa.array(a, pa.int64()) for a in (u, v, cell, fp)]
        return pa.RecordBatch.from_arrays(arrays, schema=LINKS)

    def closed(cell: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.nonzero(np.diff(cell))[0] + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(cell)]))
        sizes = ends - starts
        us, vs = [], []
        # Cells of two entries, which are most of those with any company, at once.
        two = starts[sizes == 2]
        near = _bits(fp[two] ^ fp[two + 1]) <= reach
        us.append(rep[two + 1][near])
        vs.append(rep[two][near])
        # Of cells of a few entries, those where some pair is near.
        busy = sizes > SMALL
        for n in range(3, SMALL + 1):
            at = np.nonzero(sizes == n)[0]
            few = fp[starts[at][:, None] + np.arange(n)]
            left, right = np.triu_indices(n, 1)
            busy[at] = (_bits(few[:, left] ^ few[:, right]) <= reach).any(1)
        for a, b in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            if b - a > block:
                yield give(rep[a:b], None, cell[a:b], fp[a:b].view(np.int64))
                continue
            u, v = _forest(fp[a:b], rep[a:b], reach)
            us.append(u)
            vs.append(v)
        yield give(np.concatenate(us), np.concatenate(vs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # the run not yet ended; the cell of a run that is being given out
        for batch in batches:
            cell, fp, rep = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if large is not None and len(cell):
                k = int(np.searchsorted(cell, large, "right"))
                if k:
                    yield give(rep[:k], None, cell[:k], fp[:k].view(np.int64))
                cell, fp, rep = cell[k:], fp[k:], rep[k:]
                large = large if not len(cell) else None
            if not len(cell):
                continue
            if held is not None:
                cell, fp, rep = (np.concatenate(x) for x in zip(held, (cell, fp, rep), strict=True))
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield from closed(cell[:last], fp[:last], rep[:last])
            held = cell[last:], fp[last:], rep[last:]
            if len(held[0]) > block:
                yield give(held[2], None, held[0], held[1].view(np.int64))
                held, large = None, int(cell[-1])
        if held is not None:
            yield from closed(*held)

    return run


def _links_of_large(members: DataFrame, reach: int, block: int) -> DataFrame:
    """Links of the cells over ``block``: each entry goes to a block of its cell, and each pair of
    blocks is compared in a group of its own, of two blocks' entries."""
    blocks = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = members.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", "fp", F.col("u").alias("rep"), "own",
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = _forest(rows.fp.to_numpy().view(np.uint64), rows.rep.to_numpy(), reach)
        return pd.DataFrame({"u": u, "v": v})

    return pairs.groupBy("cell", "a", "b").applyInPandas(compare, "u long, v long")


def near_links(entries: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """``entries`` (fp, rep: different fingerprints): links (u, v) of reps that span every group
    connected by pairs within ``reach`` bits."""
    if not 0 <= reach <= 4:
        raise ValueError("the grid's cells hold every pair for a reach of up to four")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Entries are narrow and lie in few files; each becomes some fifty cells, so they are dealt out before.
    cells = entries.repartition(parts).select(F.explode(_cells(F.col("fp"))).alias("cell"), "fp", "rep")
    runs = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    found = settled(
        runs.mapInArrow(_links_by_run(reach, block), "u long, v long, cell long, fp long").where(
            "v is not null or cell is not null"
        ),
        "links",
    )
    links, large = found.where("cell is null").select("u", "v"), found.where("cell is not null")
    if large.isEmpty():
        return links
    return links.unionByName(_links_of_large(large, reach, block))


def simhash_groups(
    docs: DataFrame,
    words: int = 5,
    reach: int = 4,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, fp (long) and component_id (the least id reachable by links) of each row."""
    rows = settled(fingerprints(docs, words, id_col, text_col), "fingerprints")
    entries = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    # The least id stands for a fingerprint; rows without any id have nothing to stand for them.
    entries = settled(entries.where("least is not null"), "entries")
    lone = entries.select("fp", F.col("least").alias("rep"))
    tree = components(near_links(lone, reach, block))
    shared = entries.where("rows > 1").select("fp", F.col("least").alias("root"))
    moved = lone.join(tree.withColumnRenamed("node", "rep"), "rep").select("fp", "root")
    named = shared.join(moved.select("fp"), "fp", "left_anti").unionByName(moved)
    return rows.join(named.hint("merge"), "fp", "left").select("id", "fp", F.coalesce("root", "id").alias("component_id"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"), words=4, reach=4)
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
