"""One query of each general class over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import small
from ..sources.domain import read
from .registry import query


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS lines
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2
""", domain=False)
def a01_pricing(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("lines"))


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""", domain=False)
def j02_local_suppliers(spark, sf_dir):
    t = lambda n: read(spark, sf_dir, n)
    place = small(t("nation").join(small(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name"))
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    return sold.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", domain=False)
def j06_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""
    SELECT o_orderpriority, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderpriority) + 2 * grouping(o_orderstatus) AS INTEGER) AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)
""", domain=False)
def a22_cube(spark, sf_dir):
    level = (F.grouping("o_orderpriority") + 2 * F.grouping("o_orderstatus")).cast("int")
    return read(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), level.alias("level"))


@query("""
    SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3
""", domain=False)
def w03_top_per_group(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", rank.alias("rank")).where("rank <= 3")


@query("""
    SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
        count(*) OVER (PARTITION BY o_custkey) AS orders FROM orders
""", domain=False)
def w04_running_totals(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    running = F.sum("o_totalprice").over(by.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(running, 2).alias("running"), F.count("*").over(by).alias("orders"))


@query("""
    SELECT n_nationkey AS k, 'nation' AS kind FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region
""", domain=False)
def u01_union_all(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("kind"))
    return n.unionByName(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.lit("region").alias("kind")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", domain=False)
def u03_intersect(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45", domain=False)
def u04_except(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", domain=False)
def l01_top_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""
    SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS types, round(quantile_cont(p_retailprice, 0.5), 6) AS median_price, round(stddev_samp(p_size), 6) AS spread, bool_and(p_size > 0) AS sized FROM part GROUP BY 1
""", domain=False)
def a08_part_profiles(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"), F.round(F.median("p_retailprice"), 6).alias("median_price"), F.round(F.stddev_samp("p_size"), 6).alias("spread"), F.bool_and(F.col("p_size") > 0).alias("sized"))


@query("""
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k WHERE abs(coalesce(a.n, 0) - coalesce(b.n, 0)) > 5 OR a.k IS NULL OR b.k IS NULL
""", domain=False)
def u06_shadow_compare(spark, sf_dir):
    from ..operators.relational import shadow_compare

    o = read(spark, sf_dir, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return shadow_compare(side("F"), side("O"), ["k"], "n").select("k", F.coalesce("_a", F.lit(0)).alias("n_a"), F.coalesce("_b", F.lit(0)).alias("n_b"))
