"""A corpus of pages built in two passes over chunks of delivered files, each chunk committed by itself.

Pass one parses a chunk and saves its fragments and what it adds to the counts per profile; last of all it enters the
chunk in a ledger.  Pass two takes the ledger's chunks one by one and writes their pages without
what all chunks together show to be boilerplate.  Both are file streams, so what was done is known
after a failure; a chunk's folder is written whole and named by the chunk, so doing one again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import corpus

LEDGER = "chunk long, pages long, fragments long"
COUNTS = "profile string, digest string, pages long, text string"
TOTALS = "profile string, total long"


def _drain(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def first_pass(spark: SparkSession, pages: str, schema: str, work: str, parse: Callable[[DataFrame], DataFrame], files: int = 1) -> None:
    """``pages``: a folder of Parquet files, of which ``files`` make a chunk; ``parse`` gives profile, page and text of a chunk's rows."""

    def each(batch: DataFrame, chunk: int) -> None:
        at = f"chunk={chunk}"
        corpus.fragments(parse(batch), "profile", "page", "text").write.mode("overwrite").parquet(f"{work}/fragments/{at}")
        found = batch.sparkSession.read.parquet(f"{work}/fragments/{at}")
        found.groupBy("profile", "digest").agg(F.count(F.lit(1)).alias("pages"), F.min("text").alias("text")).write.mode("overwrite").parquet(f"{work}/counts/{at}")
        found.groupBy("profile").agg(F.count_distinct("page").alias("total")).write.mode("overwrite").parquet(f"{work}/totals/{at}")
        entered = found.agg(F.lit(chunk).cast("long").alias("chunk"), F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("fragments"))
        entered.coalesce(1).write.mode("overwrite").parquet(f"{work}/ledger/{at}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pages)
    _drain(stream, each, f"{work}/state/first")


def judged(spark: SparkSession, work: str, share: float = corpus.SHARE, least_pages: int = corpus.LEAST_PAGES) -> DataFrame:
    """What all chunks in the ledger together show to be boilerplate."""
    entered = ledger(spark, work).select("chunk")
    of = lambda name, schema: spark.read.schema(f"{schema}, chunk long").parquet(f"{work}/{name}").join(F.broadcast(entered), "chunk", "left_semi")
    counts = of("counts", COUNTS).groupBy("profile", "digest").agg(F.sum("pages").alias("pages"), F.min("text").alias("text"))
    totals = of("totals", TOTALS).groupBy("profile").agg(F.sum("total").alias("total"))
    return corpus.judge(counts, totals, share, least_pages)


def ledger(spark: SparkSession, work: str) -> DataFrame:
    """The chunks that pass one has finished."""
    return spark.read.schema(LEDGER).parquet(f"{work}/ledger/chunk=*")


def second_pass(spark: SparkSession, work: str, share: float = corpus.SHARE, least_pages: int = corpus.LEAST_PAGES) -> None:
    """Writes the pages of each finished chunk without boilerplate.  Pages of all chunks count, so pass one comes first."""

    def each(batch: DataFrame, _: int) -> None:
        # A chunk a batch, hence one row.
        for row in batch.select("chunk").collect():
            at = f"chunk={row['chunk']}"
            found = batch.sparkSession.read.parquet(f"{work}/fragments/{at}")
            corpus.prune(found, judged(batch.sparkSession, work, share, least_pages)).write.mode("overwrite").parquet(f"{work}/pages/{at}")

    stream = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(f"{work}/ledger/chunk=*")
    _drain(stream, each, f"{work}/state/second")


def built(spark: SparkSession, work: str) -> DataFrame:
    """profile, page, digest, text and held of all pages written."""
    return spark.read.parquet(f"{work}/pages").select("profile", "page", "digest", "text", "held")
