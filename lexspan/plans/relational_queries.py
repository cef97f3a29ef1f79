"""Joins, aggregates, windows and set operations on the star schema.

These use the engine's own operators as they are; they are here so that every relational category has a
query that runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import latest_before
from .registry import query, table

@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS sum_price, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
""")
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("sum_price"), F.count("*").alias("n"))


@query("""
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name
""")
def rel_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    region = t("region")
    regional = t("nation").join(region.where(F.col("r_name") == region.agg(F.min("r_name")).scalar()), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(regional, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    joined = t("lineitem").select("l_orderkey", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("n_name").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rel_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY 1) ON c_nationkey = s_nationkey")
def rel_full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), "customers", "suppliers")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


@query("SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -900")
def rel_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return n.intersect(table(spark, sf_dir, "supplier").select("s_nationkey")).subtract(table(spark, sf_dir, "customer").where("c_acctbal < -900").select("c_nationkey"))


@query("""
SELECT o_custkey, o_orderkey, rn, previous, CAST(running AS DOUBLE) AS running FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS previous, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS running
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
""")
def rel_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(-2, 0)).cast("double")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.lag("o_orderkey").over(w).alias("previous"), running.alias("running"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 largest orders: the limit is the query."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def rel_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().na.fill(0)
    return wide.select("user_id", F.col("view").alias("views"), F.col("click").alias("clicks"), F.col("purchase").alias("purchases"))


@query("SELECT b.event_id, max(a.ts) AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') b JOIN (SELECT * FROM events WHERE event_type = 'view') a ON a.user_id = b.user_id AND a.ts < b.ts AND a.ts >= b.ts - INTERVAL 2 DAY GROUP BY b.event_id")
def rel_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view within two days before each purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("ts").alias("last_view"))
    found = latest_before(e.where("event_type = 'purchase'"), views, "user_id", "at", "last_view", 2 * 86_400_000_000)
    return found.where("last_view is not null").select("event_id", "last_view")


@query("SELECT label, count(*) AS vectors, round(avg(list_dot_product(embedding, embedding)), 2) AS mean_square FROM embeddings GROUP BY label")
def rel_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0).cast("float"), lambda a, x: (a + x * x).cast("float"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(square), 2).alias("mean_square"))


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, CAST(median(p_size) AS DOUBLE) AS middle FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size BETWEEN 5 AND 15 GROUP BY p_brand HAVING count(*) > 10")
def rel_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size between 5 and 15").select("p_partkey", "p_brand", "p_size")
    joined = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.median("p_size").alias("middle")).where("n > 10").drop("n")
