"""Exact dedup as stateful streaming with disk-backed keyed state.

A file stream over the documents feeds a keyed aggregate whose state lives in RocksDB and never
expires.  Per SHA-256 digest the state keeps the stable identifier (the largest id seen), how
many rows had the digest, and a content locator (a key of the keeper's file and row), not the
content.  Rows of one digest are combined before the shuffle, so a text that makes up a third of
the corpus costs one state row per map task.

A digest seen more than once is a hit.  For hits the keeper's bytes are fetched by locator and
compared with the full bytes of each row; rows whose digest agrees but whose bytes do not are
grouped again by their bytes.

Defined results
    null text counts as the empty text; null ids rank below every other id; of rows that repeat
    an id with the same text exactly one is kept; an empty table gives an empty result; columns
    other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm._shared import scratch, settled, table, text_or_empty

LOWEST = -(2**63)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Id, text, digest and locator of each row; the locator is a key of file and row number."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        text_or_empty(text_col).alias("body"),
        digest(text_or_empty(text_col)).alias("digest"),
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("at"),
    )


def _pattern(path: str) -> str:
    """A glob that matches ``path`` alone: a file stream takes a single file only as a glob."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def registry(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    bytes_per_batch: int = 256 << 30,
    files_per_batch: int | None = None,
    state_path: str | None = None,
) -> DataFrame:
    """Stream ``path`` through the keyed state; the digests met more than once.

    Columns: digest, n (rows so far), keep_id, keep_at (locator).  The stream's checkpoint and its
    output lie in shared space, so a lost executor's state is loaded again from there.  With
    ``state_path`` they stay there: a later call reads only the files that came since, and holds
    their rows against all rows before.
    """
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        # Many small stores: no space set aside ahead, changes written instead of whole snapshots.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
    }.items():
        session.conf.set(key, value)
    out, state = (f"{state_path}/{name}" if state_path else scratch(spark, name) for name in ("registry", "state"))
    step = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {"maxBytesPerTrigger": bytes_per_batch}
    reader = session.readStream.schema(spark.read.parquet(path).schema).options(**step)
    rank = F.coalesce("id", F.lit(LOWEST))
    keyed = (
        _rows(reader.parquet(_pattern(path)), id_col, text_col, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"), F.max_by("at", rank).alias("keep_at"))
    )

    def put(batch: DataFrame, number: int) -> None:
        # A batch that runs again overwrites what it wrote before.
        batch.where("n > 1").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        keyed.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )
    query.awaitTermination()
    fields = "digest string, n long, keep_id long, keep_at long"
    last = query.lastProgress
    if last is None and not state_path:
        return spark.createDataFrame([], fields)
    found = spark.read.schema(f"{fields}, batch int").parquet(out)
    if last is not None and last["batchId"] == 0:
        return found.drop("batch")
    # The count of a digest only grows: its last row is the one with the most rows.
    return found.groupBy("digest").agg(
        F.max("n").alias("n"), F.max_by("keep_id", "n").alias("keep_id"), F.max_by("keep_at", "n").alias("keep_at")
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    **stream: object,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: id, digest, keep_id, group_size, kept."""
    hits = settled(registry(spark, path, id_col, text_col, digest, **stream), "hits")
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    # Texts move once, and only those of hits are written.  The many rows of one digest are on the
    # streamed side of a merge join, where adaptive execution splits them.
    tagged = settled(
        rows.join(hits.hint("merge"), "digest", "left").withColumn("body", F.when(F.col("n") > 1, F.col("body"))),
        "tagged",
    )
    plain = tagged.select(
        "id",
        "digest",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("n").isNull() | (F.col("at") == F.col("keep_at"))).alias("kept"),
    )
    again = tagged.where("n > 1")
    keepers = again.where("at = keep_at").select("digest", F.col("body").alias("keep_body"))
    clashing = settled(
        again.where("at <> keep_at")
        .join(keepers.hint("merge"), "digest")
        .where("body <> keep_body")
        .select("digest")
        .distinct(),
        "clashing",
    )
    if clashing.isEmpty():
        return plain
    # A digest with different texts: its rows are grouped by their bytes instead.
    apart = rows.join(clashing, "digest", "left_semi")
    by_text = apart.groupBy("digest", "body").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max("id").alias("keep_id"),
        F.max_by("at", F.coalesce("id", F.lit(LOWEST))).alias("keep_at"),
    )
    regrouped = apart.join(by_text, ["digest", "body"]).select(
        "id", "digest", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept")
    )
    return plain.join(clashing, "digest", "left_anti").select(regrouped.columns).unionByName(regrouped)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
