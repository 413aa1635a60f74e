"""Relational capabilities on the star schema: what the engine's flows lean on, by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .registry import query
from .views import Tables


@query("rel-star-join", """SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY r_name, n_name""")
def star(t: Tables) -> DataFrame:
    facts = t.lineitem.join(t.orders.where("o_orderdate >= timestamp'1995-01-01'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = facts.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("rel-rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("rel-cube", "SELECT event_type, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY CUBE (event_type, hour(ts))")
def cube(t: Tables) -> DataFrame:
    return t.events.withColumn("hour", F.hour("ts")).cube("event_type", "hour").agg(F.count(F.lit(1)).alias("n"))


@query("rel-semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("rel-anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rel-pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def pivot(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().na.fill(0)


@query("rel-as-of", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events")
def as_of(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("last_view"))


@query("rel-json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_paths(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("rel-decimal", "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority")
def decimals(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("rel-dates", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, count(*) AS n, round(avg(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate)), 4) AS mean_day FROM orders GROUP BY 1, 2")
def dates(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.datediff("o_orderdate", F.lit("1990-01-01"))), 4).alias("mean_day"))


@query("rel-top-per-group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def top_orders(t: Tables) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.withColumn("rn", rn).where("rn <= 2").select("o_custkey", "o_orderkey")


@query("rel-approx-distinct", None)
def approximate(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5).alias("median"))
