"""Queries on what Spark adds: grouping sets, set operations, approximate counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.plans._registry import query
from lodestrata.session import table


@query("rollup_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("cube_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_totals(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("set_operations", "SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, d):  # noqa: ANN001, ANN201
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select("c_custkey")
    one = lambda rows, side: rows.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return one(o.intersect(c), "both").unionByName(one(c.subtract(o), "customers_only"))


@query("tagged_append", "SELECT 'a' AS origin, s_suppkey AS k FROM supplier UNION ALL SELECT 'b', n_nationkey FROM nation")
def tagged_append(spark, d):  # noqa: ANN001, ANN201
    a = table(spark, d, "supplier").select(F.lit("a").alias("origin"), F.col("s_suppkey").alias("k"))
    return a.unionByName(table(spark, d, "nation").select(F.lit("b").alias("origin"), F.col("n_nationkey").cast("long").alias("k")))


@query("approximate_users")
def approximate_users(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):  # noqa: ANN001, ANN201
    items = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0)
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), revenue.alias("revenue"), F.count(F.lit(1)).alias("n"))
