"""Sharding by extendible hashing, in native expressions only.

A directory is indexed by the leading bits of a hash of the row's id and text.  A bucket over its
byte limit splits on one more bit, and only then, until every shard fits.  Bytes are summed per
cell of ``step`` bits and rolled up over its shallower prefixes; rows of cells that are still too
large are looked at again under the next bits, so each round reads fewer rows.

Rows that agree in all bits of the hash are equal rows, which no bit can part.  Such a bucket gets
overflow pages: its rows are dealt to as many shards as it takes.  A single row over the limit is a
shard of its own.

Defined results
    null texts have no bytes and null ids hash like any value; repeated rows go to one bucket, or to
    its pages; an empty table gives an empty result; other columns are kept by ``write_shards`` and
    don't bear on the shard, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm._shared import free_name, settled, table

BYTE_LIMIT = 128 << 20
#: Bits of the hash: so many hexadecimal digits of an MD5, a sign bit short of a long.
DIGITS = 15
BITS = 4 * DIGITS
STEP = 12
#: What names of folders begin with.
FOLDER = "b"
#: Parts in which equal rows are numbered.
PARTS = 64


def hash_bits(id_col: str, text_col: str) -> Column:
    """The leading 60 bits of the MD5 of id and text."""
    shown = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(shown), 1, DIGITS), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column) -> Column:
    """The first ``depth`` of the hash's bits as a number."""
    return F.call_function("shiftrightunsigned", bits, F.lit(BITS) - depth)


def directory(rows: DataFrame, byte_limit: int, step: int = STEP) -> DataFrame:
    """The buckets of ``rows`` (bits long, bytes long): depth, prefix, bytes, rows.

    Every row is in exactly one of them; all but those at full depth fit the limit.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], "depth int, prefix long, bytes long, rows long")
    rest, low = rows, 0
    while low < BITS:
        high = min(BITS, low + step)
        cells = rest.groupBy(_prefix(F.col("bits"), F.lit(high)).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        levels = cells.select("cell", "bytes", "rows", depths)
        levels = levels.groupBy(
            "depth", F.call_function("shiftrightunsigned", F.col("cell"), F.lit(high) - F.col("depth")).alias("prefix")
        ).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        levels = settled(levels, "levels")
        fits = (F.col("bytes") <= byte_limit) | (F.col("depth") == BITS)
        # A bucket is a leaf if it fits and the bucket one bit shorter did not.
        over = levels.where(~fits).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        top = levels.where(fits & (F.col("depth") == 0)) if not low else levels.limit(0)
        leaves = levels.where(fits & (F.col("depth") > low)).join(over, ["depth", "prefix"], "left_semi")
        found = settled(found.unionByName(top.select(found.columns)).unionByName(leaves.select(found.columns)), "leaves")
        large = settled(levels.where(~fits & (F.col("depth") == high)).select(F.col("prefix").alias("cell")), "large")
        if high == BITS or large.isEmpty():
            return found
        rest = settled(rest.withColumn("cell", _prefix(F.col("bits"), F.lit(high))).join(large, "cell", "left_semi").drop("cell"), "rest")
        low = high
    return found


def assign_shards(docs: DataFrame, byte_limit: int = BYTE_LIMIT, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, shard (the bits of its bucket, and a page where there are several), depth, bytes, and
    shard_bytes and shard_rows of its shard, for each row of ``docs``."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = settled(docs.select(F.col(id_col).alias("id"), hash_bits(id_col, text_col).alias("bits"), size.alias("bytes")), "rows")
    leaves = directory(rows.select("bits", "bytes"), byte_limit, step)
    held = _placed(rows, leaves)
    deep = leaves.where((F.col("bytes") > byte_limit) & (F.col("rows") > 1))
    if deep.isEmpty():
        return held.drop("bits")
    return _pages(held, byte_limit)


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` (bits, bytes and others) with shard, depth, shard_bytes and shard_rows of their leaf."""
    # Leaves are ranges of hash values; one is listed under each cell of a grid that it touches.  The
    # grid has two to four cells a leaf, so there are a few entries a leaf and few leaves a cell at any size.
    shallow = F.lit(min(BITS, leaves.count().bit_length() + 1))
    starts = leaves.select(
        F.call_function("shiftleft", F.col("prefix"), F.lit(BITS) - F.col("depth")).alias("start"),
        "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"),
    )
    spread = F.greatest(shallow - F.col("depth"), F.lit(0))
    first = _prefix(F.col("start"), shallow)
    cells = F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), spread) - 1)
    listed = starts.withColumn("cell", F.explode(cells)).withColumn("end", F.col("start") + F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS) - F.col("depth")))
    keyed = rows.withColumn("cell", _prefix(F.col("bits"), shallow))
    held = keyed.join(listed, "cell").where("bits >= start and bits < end")
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    own = [c for c in rows.columns if c not in ("bits", "bytes")]
    return held.select(*own, "bits", shard.alias("shard"), "depth", "bytes", "shard_bytes", "shard_rows")


def _pages(held: DataFrame, byte_limit: int) -> DataFrame:
    """Overflow pages of buckets that hold equal rows: each page takes what fits the limit."""
    large = (F.col("shard_bytes") > byte_limit) & (F.col("shard_rows") > 1)
    fit = F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    # Equal rows are counted where they are, then written out again page by page.
    counted = held.where(large).groupBy("id", "bits", "shard", "depth", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    pages = counted.withColumn("fit", fit).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / F.col("fit")) - 1)))
    own = F.least(F.col("fit"), F.col("copies") - F.col("page") * F.col("fit"))
    paged = pages.withColumn("own", own).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own"))))
    paged = paged.select("id", F.concat("shard", F.lit("."), F.col("page")).alias("shard"), "depth", "bytes", (F.col("own") * F.col("bytes")).alias("shard_bytes"), F.col("own").alias("shard_rows"))
    return held.where(~large).drop("bits").unionByName(paged)


def write_shards(docs: DataFrame, path: str, byte_limit: int = BYTE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` into one folder per shard; overflow pages are shards of their own.

    A folder's name begins with ``FOLDER``, so that it isn't read back as a number.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, hash_bits(id_col, text_col).alias("bits"), size.alias("bytes"))
    leaves = directory(settled(rows.select("bits", "bytes"), "rows"), byte_limit)
    held, name = _placed(rows, leaves), free_name(docs, "shard")
    large = (F.col("shard_bytes") > byte_limit) & (F.col("shard_rows") > 1)
    # Equal rows are numbered in parts, so that no task has to count them all.
    paged = settled(held.where(large).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "paged")
    before = F.sum("count").over(Window.partitionBy("bits").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = paged.groupBy("bits", "part").count().select("bits", "part", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("bits", "part").orderBy("bytes")) - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest(F.col("bytes"), F.lit(1))))
    page = F.floor(number / fit).cast("long")
    paged = paged.join(counts, ["bits", "part"]).select("row", F.concat("shard", F.lit("."), page).alias("shard"))
    out = held.where(~large).select("row", "shard").unionByName(paged).select("row.*", F.concat(F.lit(FOLDER), "shard").alias(name))
    out.repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)


#: The tables at hand are small; a limit of 1 MiB splits them as 128 MiB splits a corpus.
QUERY_LIMIT = 1 << 20


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents"), QUERY_LIMIT)
    return found.select(F.col("id").alias("doc_id"), "shard", "depth", F.col("bytes").alias("n_bytes"), "shard_bytes", "shard_rows")


SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {DIGITS}))::BIGINT AS bits
    FROM documents
),
l AS (SELECT doc_id, n_bytes, depth, bits >> ({BITS} - depth) AS prefix FROM d, unnest(range(0, 31)) AS r(depth)),
b AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY depth, prefix),
f AS (
    SELECT l.doc_id, l.n_bytes, l.prefix, b.depth, b.shard_bytes, b.shard_rows,
        row_number() OVER (PARTITION BY l.doc_id ORDER BY b.depth) AS k
    FROM l JOIN b ON l.depth = b.depth AND l.prefix = b.prefix WHERE b.shard_bytes <= {QUERY_LIMIT}
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(to_base(prefix, 2), depth::INT, '0') END AS shard,
    depth::INT AS depth, n_bytes, shard_bytes, shard_rows FROM f WHERE k = 1
"""
