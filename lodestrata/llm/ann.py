"""Approximate nearest neighbours by inverted lists and an adaptive dimension scan.

Index
    Equal vectors are one entry that carries their smallest ids, so a vector that makes up a third
    of the table is one entry.  k-means centres, fitted on a bounded sample (``SAMPLE`` rows), split all entries into
    lists; lists of more than ``chunk`` entries are split into chunks.
Search
    Vectors are turned by a random rotation, after which any block of dimensions tells about the
    whole.  A floor that the query's results won't be below comes from its products within the
    sample.  In each chunk of the lists a query probes, candidates are read in blocks of columns.
    After each block a hypothesis test compares the distance so far, scaled to all dimensions, with
    the distance a candidate must have, and abandons those that fail.  Survivors are scored exactly
    on the original vectors in double precision.  The best of all chunks are the result; a query
    left with too few is held against all lists without a floor.

Nearness is the inner product; as ||q - x||^2 = ||q||^2 + ||x||^2 - 2 <q, x>, a candidate reaches
the floor exactly if its squared distance is within a bound of its own.

Defined results
    vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do
    vectors of another length than the table's most frequent (the larger, of equally frequent);
    rows with a null id take no part; repeated rows of one id are candidates of their own for other
    queries, and a query never finds its own id; ties go to the smaller id; an empty table gives an
    empty result; columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm._shared import settled, table

#: Rows that the centres are fitted on, at most.
SAMPLE = 16_384
#: Entries to a list on average, and the most lists.
PER_LIST, MOST_LISTS = 256, 4096
CHUNK, BLOCK = 4096, 16
#: Queries that are compared with a chunk at once.
QUERIES = 512
#: The floor is the product at so many times k in the sample.
SLACK = 3
#: Probes are set so that this share of the sample's own nearest neighbours is in probed lists,
#: judged by so many of its vectors.
TARGET, JUDGES = 0.98, 512
#: Standard errors that the test allows: the larger, the fewer neighbours are lost.
EPSILON = 2.1
SEED = 7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of doubles) of the rows that take part."""
    v = F.col("v")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null").where(good)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of the sample's directions."""
    points = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(SEED)
    found = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(points[k : k + 2048] @ found.T).argmax(1) for k in range(0, len(points), 2048)])
        sums, counts = np.zeros_like(found), np.bincount(own, minlength=lists)
        np.add.at(sums, own, points)
        found = np.where(counts[:, None] > 0, sums, found)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def probes_for(sample: np.ndarray, middle: np.ndarray, k: int, target: float = TARGET) -> int:
    """How many lists to probe so that the sample's own neighbours are met as often as ``target``."""
    own = np.concatenate([(sample[i : i + 2048] @ middle.T).argmax(1) for i in range(0, len(sample), 2048)])
    places = []
    for i in np.random.default_rng(SEED).permutation(len(sample))[:JUDGES]:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        near = np.argpartition(-scores, min(k, len(sample) - 1))[:k]
        order = np.empty(len(middle), int)
        order[np.argsort(-(middle @ sample[i]))] = np.arange(len(middle))
        places.append(order[own[near]])
    return 1 + int(np.quantile(np.concatenate(places), target, method="higher"))


def floors_for(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best product within the sample: no k-th best of all rows is below it."""
    if len(sample) < k:
        return np.full(len(queries), -np.inf)
    return np.concatenate(
        [np.partition(queries[i : i + 256] @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k] for i in range(0, len(queries), 256)]
    )


def scan(rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, queries: np.ndarray, turned_queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk, for each query up to k rows that reach its floor: query places, ids, scores.

    The first block of columns is read for all pairs, each further block for the pairs left.
    """
    dims = rows.shape[1]
    # A pair reaches the floor exactly if its squared distance is at most this.
    bound = (queries * queries).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * floors[:, None]
    seen = min(BLOCK, dims)
    a, b = turned_queries[:, :seen], turned[:, :seen]
    part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    q, x = np.nonzero(part * (dims / seen) <= bound * (1 + EPSILON / math.sqrt(seen)) ** 2 + TINY)
    part, bound = part[q, x], bound[q, x]
    for at in range(seen, dims, BLOCK):
        part = part + ((turned_queries[q, at : at + BLOCK] - turned[x, at : at + BLOCK]) ** 2).sum(1)
        seen = min(dims, at + BLOCK)
        if seen < dims:
            keep = part * (dims / seen) <= bound * (1 + EPSILON / math.sqrt(seen)) ** 2 + TINY
            q, x, part, bound = q[keep], x[keep], part[keep], bound[keep]
    keep = part <= bound + TINY
    q, x = q[keep], x[keep]
    scores = (rows[x] * queries[q]).sum(1)
    order = np.lexsort((ids[x], -scores, q))
    q, x, scores = q[order], x[order], scores[order]
    starts = np.searchsorted(q, q)
    best = np.arange(len(q)) - starts < k
    return q[best], ids[x[best]], scores[best]


#: Allowance for rounding in the comparison of distances.
TINY = 1e-9


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    probes: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` nearest found of each row for which
    ``is_query`` (a condition on the id column) holds, against all rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Of equal vectors the k + 1 smallest ids: more can't be among k results besides the query.
    # The limit is applied in each map task before rows are shuffled.
    same = Window.partitionBy("v").orderBy("id")
    members = settled(
        rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).withColumn("rep", F.first("id").over(same)),
        "members",
    )
    entries = members.where("n = 1").select(F.col("id").alias("rep"), "v")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    sample = np.array([r["v"] for r in entries.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()])
    lists = max(1, min(MOST_LISTS, total // PER_LIST, len(sample) // 4))
    middle = centres(sample, lists)
    shared = spark.sparkContext.broadcast((rotation(sample.shape[1]), middle, sample))
    probes = min(probes or probes_for(sample, middle, k), lists)

    def assign(count: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, middle, known = shared.value
            for batch in batches:
                v = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.argpartition(-(v @ middle.T), count - 1, axis=1)[:, :count] if count < len(middle) else np.tile(np.arange(len(middle)), (len(v), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in v]), pa.array([x.tobytes() for x in v @ turn]), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(floors_for(v, known, SLACK * (k + 1)) if count > 1 else np.zeros(len(v)))],
                    names=["rep", "raw", "turned", "lists", "floor"],
                )

        return run

    shape = "rep long, raw binary, turned binary, lists array<int>, floor double"
    index = settled(
        entries.mapInArrow(assign(1), shape).select("rep", "raw", "turned", F.element_at("lists", 1).alias("list")), "index"
    )
    sizes = dict(index.groupBy("list").count().collect())  # one row a list: at most MOST_LISTS
    chunks = F.array(*(F.lit(-(-sizes.get(c, 1) // CHUNK)) for c in range(lists)))
    data = index.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.element_at(chunks, F.col("list") + 1)).cast("int"))

    # Equal queries are searched once.
    wanted = rows.where(is_query).join(entries, "v").select(F.col("id").alias("query_id"), "rep").distinct()
    wanted = settled(wanted, "wanted")
    def spread(probed: DataFrame) -> DataFrame:
        rows = probed.select("rep", "raw", "turned", "floor", F.explode("lists").alias("list"))
        return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(chunks, F.col("list") + 1) - 1)))

    asked = settled(entries.join(wanted.select("rep").distinct(), "rep", "left_semi").mapInArrow(assign(probes), shape), "asked")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        matrix = lambda column: np.frombuffer(b"".join(column), float).reshape(len(column), -1)
        data, turned, ids = matrix(left.raw), matrix(left.turned), left.rep.to_numpy()
        for at in range(0, len(right) if len(left) else 0, QUERIES):
            some = right.iloc[at : at + QUERIES]
            q, found, scores = scan(data, turned, ids, matrix(some.raw), matrix(some.turned), some.floor.to_numpy(), k + 1)
            out.append((some.rep.to_numpy()[q], found, scores))
        if not out:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        q, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"q": q, "rep": found, "score": scores})

    by = ("list", "chunk")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "rep")

    def best_of(probed: DataFrame) -> DataFrame:
        met = data.groupBy(*by).cogroup(spread(probed).groupBy(*by)).applyInPandas(search, "q long, rep long, score double")
        return met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")

    found = settled(best_of(asked), "found")
    # Queries whose floor or lists left them short are held against all lists without a floor.
    enough = found.groupBy(F.col("q").alias("rep")).count().where(F.col("count") >= min(k + 1, total))
    short = settled(asked.join(enough, "rep", "left_anti"), "short")
    if not short.isEmpty():
        every = F.array(*map(F.lit, range(lists)))
        more = best_of(short.withColumn("lists", every).withColumn("floor", F.lit(float("-inf"))))
        found = found.join(short.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(more)
    # Back from entries to ids: of each searched vector the k + 1 best ids, then for each query of
    # that vector those that are not itself.
    ids = found.join(members.select("rep", "id"), "rep")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ids = ids.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "id", "score", "n")
    hits = wanted.join(ids, F.col("rep") == F.col("q")).where("id <> query_id")
    place = Window.partitionBy("query_id").orderBy("n")
    return (
        hits.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
