"""Queries on state: upserts, replacements, syncs, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import upsert
from lodestrata.plans._registry import query
from lodestrata.session import table


def _halves(spark, d):  # noqa: ANN001, ANN202
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0")


@query("upsert_latest_wins", "WITH c AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), n AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT coalesce(n.o_custkey, c.o_custkey) AS o_custkey, coalesce(n.k, c.k) AS k, n.k IS NOT NULL AS renewed FROM c FULL JOIN n USING (o_custkey)")
def upsert_latest_wins(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders")
    current = o.where("o_orderkey % 2 = 1").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).withColumns({"at": F.lit(None).cast("timestamp_ntz"), "renewed": F.lit(False)})
    new = o.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(True).alias("renewed"))
    return upsert.upsert(current, new, ["o_custkey"], [F.desc("at"), F.desc("k")]).drop("at")


@query("child_replace", "SELECT l_orderkey, l_linenumber, l_partkey, 'old' AS version FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'new' FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber <= 2")
def child_replace(spark, d):  # noqa: ANN001, ANN201
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    touched = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = items.join(touched, "l_orderkey", "left_anti").withColumn("version", F.lit("old"))
    return kept.unionByName(items.where("l_orderkey % 4 = 0 and l_linenumber <= 2").withColumn("version", F.lit("new")))


@query("partition_replace", "SELECT doc_id, source, 1 AS version FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 2 FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 3 = 0")
def partition_replace(spark, d):  # noqa: ANN001, ANN201
    docs = table(spark, d, "documents").select("doc_id", "source")
    new = docs.where(F.col("source").isin("src1", "src2") & (F.col("doc_id") % 3 == 0)).withColumn("version", F.lit(2))
    return upsert.replace_partitions(docs.withColumn("version", F.lit(1)), new, ["source"])


@query("sticky_coalesce", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END, c_acctbal) ELSE c_acctbal END AS last_success, CASE WHEN c_custkey % 3 = 0 THEN 'renewed' ELSE c_mktsegment END AS status, c_name AS first_name FROM customer")
def sticky_coalesce(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "customer")
    current = c.select("c_custkey", F.col("c_acctbal").alias("last_success"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("first_name"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("last_success"), F.lit("renewed").alias("status"), F.lit("other").alias("first_name"))
    return upsert.upsert_listed(current, new, ["c_custkey"], ["status"], ("last_success",))


@query("insert_missing", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def insert_missing(spark, d):  # noqa: ANN001, ANN201
    a, b = _halves(spark, d)
    return upsert.insert_missing(a, b, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("sheet_sync", "SELECT 'stays' AS side, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'goes', count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0")
def sheet_sync(spark, d):  # noqa: ANN001, ANN201
    stays, goes = upsert.sync(*_halves(spark, d), ["o_orderkey"])
    one = lambda rows, side: rows.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return one(stays, "stays").unionByName(one(goes, "goes"))


@query("schema_union", "SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0")
def schema_union(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders")
    return upsert.grow_schema(o.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderpriority"))


@query("unchanged_skip", "SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 4 = 0")
def unchanged_skip(spark, d):  # noqa: ANN001, ANN201
    new = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("h"))
    last = new.select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit("changed")).otherwise(F.col("h")).alias("h"))
    return upsert.unchanged(new, last, "page_id", "h")


@query("resume_difference", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def resume_difference(spark, d):  # noqa: ANN001, ANN201
    pages = table(spark, d, "pages").select("page_id")
    return pages.join(pages.where("page_id % 3 = 0"), "page_id", "left_anti")


@query("quarantine_status", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'quarantined' ELSE o_orderstatus END AS status FROM orders")
def quarantine_status(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    return upsert.quarantined(rows, F.when(F.col("o_totalprice") < 1000, "price")).drop("o_totalprice")


@query("run_numbers", "SELECT event_id, user_id || '-' || lpad(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR, 4, '0') AS run_id FROM events")
def run_numbers(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("run_id"))


@query("last_per_source", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_per_source(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("coverage_flag_update", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'complete' ELSE 'partial' END AS coverage FROM customer")
def coverage_flag_update(spark, d):  # noqa: ANN001, ANN201
    c = table(spark, d, "customer").select("c_custkey")
    flags = c.where("c_custkey % 5 = 0").withColumn("flag", F.lit("complete"))
    return c.join(flags, "c_custkey", "left").select("c_custkey", F.coalesce("flag", F.lit("partial")).alias("coverage"))
