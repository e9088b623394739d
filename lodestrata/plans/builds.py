"""Queries on builds: two passes over chunks, contents parsed by version, recorded runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import run_records
from lodestrata.operators.corpus import sections
from lodestrata.plans._registry import ORACLES, query
from lodestrata.session import scratch, table
from lodestrata.sources import reparse
from lodestrata.streaming import page_build


@query("chunked_build", ORACLES["boilerplate_pruned"])
def chunked_build(spark, d):  # noqa: ANN001, ANN201
    """Documents delivered in files, a chunk each, built in two passes; equal to one batch over all."""
    work, docs = scratch(spark, "build"), table(spark, d, "documents").select("doc_id", "source", "text")
    docs.repartitionByRange(5, "doc_id").write.parquet(f"{work}/delivered")
    parse = lambda rows: sections(rows).select(F.col("host").alias("profile"), "page", "text")
    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes)
    page_build.first_pass(spark, f"{work}/delivered", schema, work, parse)
    page_build.second_pass(spark, work, 0.06, 3)
    return page_build.built(spark, work).groupBy("page").agg(F.count(F.lit(1)).alias("fragments"), F.bool_or("held").alias("held"))


@query(
    "versioned_parse",
    """
    WITH n AS (SELECT count(DISTINCT regexp_replace(regexp_replace(html, '[?&](?:ver|v|_|ts|cb|rnd|nocache)=\\d+', '', 'g'), '(?i)jsessionid=[0-9A-F]+', '', 'g')) AS c FROM pages)
    SELECT * FROM (SELECT 'first' AS run, c AS parsed, 0 AS kept FROM n UNION ALL SELECT 'again', 0, c FROM n UNION ALL SELECT 'new version', c, 0 FROM n UNION ALL SELECT 'same pages seen again', 0, c FROM n)
    """,
)
def versioned_parse(spark, d):  # noqa: ANN001, ANN201
    """How many contents each run parses: all, none, all by a new version, none where pages come back unchanged."""
    store, pages = scratch(spark, "contents"), table(spark, d, "pages")
    seen = lambda day: pages.select("url", F.col("html").alias("body"), F.lit(f"2024-05-0{day} 00:00:00").cast("timestamp").alias("fetched_at"))
    titles = lambda rows: rows.select("content", F.regexp_extract("body", "<title>(.*?)</title>", 1).alias("title"))
    reparse.save(seen(1), store)
    runs = [("first", reparse.reparse(spark, store, "1", titles)), ("again", reparse.reparse(spark, store, "1", titles)), ("new version", reparse.reparse(spark, store, "2", titles))]
    reparse.save(seen(2), store)
    runs.append(("same pages seen again", reparse.reparse(spark, store, "1", titles)))
    return spark.createDataFrame([(name, x["parsed"], x["kept"]) for name, x in runs], "run string, parsed long, kept long")


@query("versioned_titles", "SELECT url, coalesce(nullif(regexp_extract(html, '<title>(.*?)</title>', 1), ''), '') AS title FROM pages")
def versioned_titles(spark, d):  # noqa: ANN001, ANN201
    """Each address with what the newest version made of its newest content."""
    store, pages = scratch(spark, "contents"), table(spark, d, "pages")
    reparse.save(pages.select("url", F.lit("<title>old</title>").alias("body"), F.lit("2024-05-01 00:00:00").cast("timestamp").alias("fetched_at")), store)
    reparse.save(pages.select("url", F.col("html").alias("body"), F.lit("2024-05-02 00:00:00").cast("timestamp").alias("fetched_at")), store)
    reparse.reparse(spark, store, "1", lambda rows: rows.select("content", F.lit("nothing").alias("title")))
    reparse.reparse(spark, store, "2", lambda rows: rows.select("content", F.regexp_extract("body", "<title>(.*?)</title>", 1).alias("title")))
    return reparse.latest(spark, store, "2").select("url", "title")


@query(
    "job_runs",
    """
    SELECT 'customers' AS source_key, 'success' AS outcome, count(*) AS rows, 0 AS set_apart FROM customer
    UNION ALL SELECT 'orders', CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'quarantine' ELSE 'success' END, count(*), count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'parts', 'error', NULL, NULL FROM (SELECT count(*) FROM part)
    """,
)
def job_runs(spark, d):  # noqa: ANN001, ANN201
    """Three jobs and how they ended: one in order, one with rows set apart, one that fails while it writes."""
    runs = scratch(spark, "runs")
    write = lambda rows: rows.write.parquet(scratch(spark, "job"))
    run_records.recorded(spark, runs, "customers", lambda: table(spark, d, "customer"), write)
    run_records.recorded(spark, runs, "orders", lambda: table(spark, d, "orders"), write, F.col("o_orderstatus") == "P")
    try:
        run_records.recorded(spark, runs, "parts", lambda: table(spark, d, "part").withColumn("x", F.when(F.col("p_partkey") > 0, F.raise_error(F.lit("no such part")))), write)
    except Exception as failed:
        if "no such part" not in str(failed):
            raise
    return run_records.last_runs(spark, runs).select("source_key", "outcome", "rows", "set_apart")
